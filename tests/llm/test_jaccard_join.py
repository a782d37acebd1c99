import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.llm import jaccard_join as J


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        shared.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_against_brute_force(docs, rows):
    got = {r[0]: (r[1], r[2]) for r in J.classify(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def chains(seed):
    """Long chains: each text is near the one before only."""
    rng = random.Random(seed)
    rows, words = [], [f"x{k}" for k in range(150)]
    for i in range(60):
        if i % 20 == 0:
            words = [f"x{seed}y{i}z{k}" for k in range(150)]
        words = list(words)
        words[rng.randrange(150)] = f"n{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("limit", [300, 2000])
def test_cells_give_the_same_components(spark, limit):
    rows = chains(3) + [(100 + i, t) for i, t in grown()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in J.classify(df, region_limit=limit).collect()} == brute(rows)


def grown():
    """A cluster around one text, whose members lie at growing distances from it."""
    rng = random.Random(8)
    base, rows = [f"c{k}" for k in range(200)], []
    for i in range(60):
        words = list(base)
        for k in range(i // 4):
            words[rng.randrange(200)] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def close_sets(seed, n=300):
    """Sets at all distances from a few centres, among them many pairs just about the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, (5, 120)).astype(np.uint64)
    sets = []
    for i in range(n):
        s = base[i % 5].copy()
        k = rng.integers(0, 18)
        s[rng.integers(0, 120, k)] = base[(i + 1) % 5][rng.integers(0, 120, k)] if i % 3 == 0 else rng.integers(0, 1 << 60, k).astype(np.uint64)
        sets.append(np.unique(s))
    return sets


def pairs(sets):
    shared = J.overlaps(sets, sets)
    n = np.array([len(s) for s in sets])
    return {(i, j) for i, j in zip(*np.nonzero(J.linked(shared, n[:, None], n[None, :]))) if i < j}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_link_meets_in_a_cell_and_windows_decide_some(seed):
    sets = close_sets(seed)
    n, k = np.array([len(s) for s in sets]), 12
    member = np.random.default_rng(seed).random(len(sets)) < 0.7
    member[:k] = True
    row, cell, own, _ = J.deal(J.overlaps(sets[:k], sets), n, n[:k], member)
    assert len(set(zip(row[own].tolist(), cell[own].tolist()))) == own.sum() == member.sum()  # one home each
    home = dict(zip(row[own].tolist(), cell[own].tolist()))
    seen = set(zip(row.tolist(), cell.tolist()))
    across = 0
    for x, y in pairs(sets):
        if member[x] or member[y]:
            met = [c for a, b in ((x, y), (y, x)) if member[a] for c in [home[a]] if (b, c) in seen]
            assert len(met) >= 1
            across += member[x] and member[y] and home[x] != home[y]
    assert across > 0  # links that only a window's copy can show


@pytest.mark.parametrize("seed", [4, 5])
def test_members_meet_those_that_are_no_members(seed):
    sets = close_sets(seed, 200)
    member = np.random.default_rng(seed).random(len(sets)) < 0.5
    got = J.Region(sets, member).solve()
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    true = J._Union(len(sets))
    for x, y in pairs(sets):
        true.join(int(x), int(y))
        if member[x] or member[y]:
            a, b = sorted((find(x), find(y)))
            up[b] = a
    # all links of members, and nothing that is no link
    assert all(got[x] == got[y] for x, y in pairs(sets) if member[x] or member[y])
    assert all(true.find(i) == true.find(g) for i, g in enumerate(got))


def test_region_solver_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 1 << 60, (4, 80)).astype(np.uint64)
        sets = []
        for i in range(60):
            s = base[i % 4].copy()
            k = rng.integers(0, 25)
            s[rng.integers(0, 80, k)] = rng.integers(0, 1 << 60, k).astype(np.uint64)
            sets.append(np.unique(s))
        got = J.Region(sets).solve()
        up = list(range(60))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(60):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                if J.linked(n, len(sets[a]), len(sets[b])):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
        assert [find(x) for x in got] == [find(x) for x in range(60)]


def test_nested_sets_link_through_the_middle_one_in_every_order():
    full = np.arange(130, dtype=np.uint64) * np.uint64(7919)
    for sizes in permutations((100, 115, 130)):
        assert len(set(J.Region([full[:n] for n in sizes]).solve())) == 1
    far = np.arange(100, dtype=np.uint64) + np.uint64(1 << 40)
    for order in permutations((full[:100], full[:115], full[:130], far)):
        assert sorted(Counter(J.Region(list(order)).solve()).values()) == [1, 3]


def test_grown_texts_are_one_component(spark):
    rows = []
    for g in range(6):  # other words, so the smallest hash is another text's
        words = [f"g{g}w{k}" for k in range(134)]
        rows += [(10 * g + i, " ".join(words[:n])) for i, n in enumerate((104, 119, 134))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in J.classify(df).collect()} == brute(rows)


def test_threshold_is_inclusive_and_edge_rows(spark, empty):
    a = [f"q{k}" for k in range(14)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:12])), (3, "one two"), (4, "ONE  two"), (5, None), (6, ""), (7, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in J.classify(df).collect()}
    assert got == brute(rows) and got[2] == (8, 1) and got[4] == (1, 3) and got[5] == (0, 5)
    assert J.classify(empty).count() == 0 and J.keep_one(empty).count() == 0
    assert sorted(r[0] for r in J.keep_one(df).collect()) == [1, 3, 5, 6, 7]


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    near = " ".join(f"n{k}" for k in range(60))
    rows = [(None, near), (None, near + " more"), (None, "other words"), (None, None), (None, "other words"), ("b", near), ("b", near), ("a", near + " end"), ("c", ""), ("c", "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2, True) for i, t in rows], "doc_id string, text string, cls int, name string, label int, _b boolean")
    got = Counter((r[0], r[1], r[2]) for r in J.classify(df).collect())
    assert got == Counter([(None, 56, "a"), (None, 57, "a"), (None, 1, None), (None, 0, None), (None, 1, None), ("b", 56, "a"), ("b", 56, "a"), ("a", 57, "a"), ("c", 0, "c"), ("c", 0, "c")])
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([("a", near + " end"), (None, "other words"), (None, None), ("c", ""), ("c", "")])


@pytest.mark.parametrize("limit", [2000, 4_000_000])
def test_tables_of_sets_go_once_they_are_read(spark, docs, limit):
    from pathlib import Path

    from tessitura.session import shared_root

    root = Path(shared_root(spark).split(":", 1)[-1])
    before = set(root.iterdir())
    J.classify(docs, limit).collect()
    left = [p.name.rsplit("-", 1)[0] for p in root.iterdir() if p not in before]
    assert not {"sets", "inside", "regions", "cells", "cut", "small"} & set(left)
    assert left.count("edges") <= 3  # each search for components leaves its last ones


def test_texts_that_share_single_shingles_are_no_region(spark):
    rng = random.Random(11)
    slots = [i for i in range(200) for _ in range(12)]
    rng.shuffle(slots)
    blocks = {i: [] for i in range(200)}
    for k, i in enumerate(slots):  # a block stands in two texts, so that too few shingles are in one only to fill the first ones
        blocks[i] += [f"b{k // 2}w{j}" for j in range(25)]
    rows = [(i, " ".join(words)) for i, words in blocks.items()]
    for i in range(0, 200, 10):  # and some have a near copy
        words = list(blocks[i])
        words[rng.randrange(300)] = f"other{i}"
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(None).cast("binary"))
    scan = df.mapInArrow(J._scan, "doc_id long, name binary, n long, cls binary, chunk int, counts binary")
    total = scan.agg(F.sum("n")).first()[0]
    sizes = [r["count"] for r in J._regions(df, "text", scan.select("chunk", "counts"), total).groupBy("label").count().collect()]
    assert max(sizes) < 10 and sum(sizes) >= 40
    assert {r[0]: (r[1], r[2]) for r in J.classify(df).collect()} == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linked_sets_share_the_needed_ones_among_their_first(seed):
    sets = close_sets(seed) + [s[:n] for s in close_sets(seed, 10) for n in (1, 2, 3, 4, 5, 6, 7, 9)]
    order = np.random.default_rng(seed).permutation(len(np.unique(np.concatenate(sets))))
    every = np.unique(np.concatenate(sets))
    firsts = [np.sort(order[np.searchsorted(every, s)])[: len(s) - J.needed(len(s)) + J.sure(len(s))] for s in sets]
    found = pairs(sets)
    assert len(found) > 100
    assert all(len(np.intersect1d(firsts[x], firsts[y])) >= J.sure(min(len(sets[x]), len(sets[y]))) for x, y in found)


def test_shingles_of_few_and_many_classes_connect_the_same(spark, monkeypatch, docs, rows):
    want = brute([(r[0], r[1]) for r in rows])
    for most in (1, 4):
        monkeypatch.setattr(J, "PAIRS", most)
        assert {r[0]: (r[1], r[2]) for r in J.classify(docs).collect()} == want
