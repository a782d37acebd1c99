import random

import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import decontamination as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert D.lcs(D.places(a), len(a), b) == lcs(a, b)


def sayer(rng):
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]


def planted(seed=4, rate=1 / 6, rare=False, n_docs=120):
    """Documents, items, and the (document, item) pairs planted: copies and paraphrases whose answer is untouched."""
    rng = random.Random(seed)
    say = sayer(rng)
    items = [(i, say(rng.randrange(16, 60))) for i in range(12)]
    docs, want = [], set()
    for d in range(n_docs):
        words = say(rng.randrange(20, 400))
        if d % 3 == 0:
            i, item = rng.choice(items)
            part = list(item)
            if d % 2:
                order = rng.sample(range(len(part) - D.ANSWER), len(part) - D.ANSWER)
                order = sorted(order, key=lambda k: part[k][0] != "v") if rare else order
                for k in order[: int(len(part) * rate)]:
                    part[k] = f"other{rng.randrange(1000)}"
            at = rng.randrange(len(words))
            words[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(words).upper().replace("THE ", "THE, ") if d % 4 == 0 else " ".join(words)))
    return docs, [(i, " ".join(w) + ".") for i, w in items], want


def exhaustive(docs, items, min_share=0.6, sure_share=0.9):
    """Every item against every stretch of every document, by the plain recurrence and the answer's words."""
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    out = set()
    for d, t in docs:
        words = plain(t)
        for i, x in items:
            item = plain(x)
            n = len(item)
            known = set(item)
            for at in range(0, max(1, len(words) - n + 1)):
                around = words[max(0, at - n // 4) : at + n + n // 4]
                if len([w for w in around if w in known]) < min_share * n or len([w for w in item if w in set(around)]) < min_share * n:
                    continue
                share = lcs(item, around) / n
                if share >= min_share and (share >= sure_share or 2 * lcs(item[-D.ANSWER :], around) > D.ANSWER):
                    out.add((d, i))
                    break
    return out


def test_finds_copies_and_paraphrases_only(spark, empty):
    docs, items, want = planted()
    df = spark.createDataFrame([*docs, (500, None), (501, ""), (0, docs[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (77, None), (78, " . ")], "item_id long, text string")
    got = D.leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want == exhaustive(docs, items) and len(got) == len(want)
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == ({d for d, _ in docs} | {500, 501}) - {d for d, _ in want}
    assert D.leaks(df, bench.limit(0)).count() == 0 and D.leaks(empty, bench).count() == 0


@pytest.mark.parametrize("rare", [False, True])
@pytest.mark.parametrize("rate", [0.2, 0.3, 0.38])
def test_recall_of_paraphrases_against_exhaustive_search(spark, rate, rare):
    docs, items, planted_pairs = planted(9, rate, rare)
    want = exhaustive(docs, items)
    latent = D.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    search = D.Search(latent, D.Items(*zip(*items), latent), 0.6, 0.9, 0.25)
    words, ends = D.hash_words(pa.array([t for _, t in docs]), D._SPACED)
    got = {(docs[t][0], items[i][0]) for t, i, *_ in search.hits(words, ends)}
    assert len(want & planted_pairs) >= 0.95 * len(planted_pairs)
    assert len(got & want) >= 0.9 * len(want) and len(got & planted_pairs) >= 0.9 * len(planted_pairs)
    assert all(pair in planted_pairs for pair in got - want)


def test_bound_never_falls_below_the_subsequence():
    rng = random.Random(2)
    say = sayer(rng)
    items = [say(rng.randrange(3, 90)) for _ in range(30)]
    text = say(900)
    latent = D.Latent(np.ones(D.FEATURES), np.zeros((D.FEATURES, 4)), np.zeros(4))
    block = D.Items(list(range(30)), [" ".join(x) for x in items], latent)
    words, ends = D.hash_words(pa.array([" ".join(text)]), D._SPACED)
    search = D.Search(latent, block, 0.6, 0.9, 0.25)
    sign = (words >> np.uint64(64 - D.SIGN_BITS)).astype(np.int64)
    before = np.array([max([q for q in range(p) if sign[q] == sign[p]], default=-1) for p in range(len(sign))])
    lo = np.array([rng.randrange(800) for _ in range(200)])
    hi = lo + [rng.randrange(1, 100) for _ in range(200)]
    item = np.array([rng.randrange(30) for _ in range(200)])
    for bound, a, b, i in zip(search.bound(sign, before, lo, hi, item), lo, hi, item, strict=True):
        assert bound >= len([w for w in items[i] if w in text[a:b]]) >= lcs(items[i], text[a:b])


def test_sums_equal_the_dense_product():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50, 700).astype(np.uint16)
    ends = np.array([0, 0, 3, 130, 130, 700])
    laid, first = D.lay_out(ids, ends, D.PASSAGE)
    w = rng.random(D.FEATURES).astype(np.float32)
    a = np.zeros((len(laid) // D.PASSAGE, D.FEATURES))
    for p, row in enumerate(laid.reshape(-1, D.PASSAGE)):
        np.add.at(a[p], row[row < D.FEATURES], 1)
    assert a.sum() == 700 and first.tolist() == [0, 0, 1, 3, 3, 12]
    a *= w
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.standard_normal((D.FEATURES, 6))
    y = np.zeros((D.FEATURES, 6), np.float32)
    D.back_product(y, laid, D._padded(r * w[:, None]), w)
    assert np.allclose(y * w[:, None], a.T @ (a @ r), atol=1e-3)


def test_rows_are_judged_by_their_text(spark):
    """Null and repeated ids, ids of another type, clashing columns, a very long text."""
    docs, items, _ = planted(5)
    leak, clean, long = "x " * 30 + items[0][1], docs[1][1], " ".join(docs[k][1] for k in range(1, 120, 3)) * 30
    rows = [(None, leak), (None, clean), (None, None), ("a", leak), ("a", clean), ("b", long), ("c", leak), ("c", leak)]
    df = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id string, text string, item_id string, _name int, cosine double")
    bench = spark.createDataFrame([("q1", items[0][1], 1), ("q1", items[1][1], 2)], "item_id string, text string, doc_id int")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in D.leaks(df, bench).collect())
    assert got == [("None", "q1"), ("a", "q1"), ("c", "q1")]
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) + str(len(r["text"] or "")) for r in kept.collect()) == sorted(str(i) + str(len(t or "")) for i, t in rows if t != leak)


@pytest.mark.parametrize("length", [1, 4, 6, 8, 12, 15])
def test_short_items(spark, length):
    """Copies of items of a few words are all found, paraphrases with up to 38 % of the words replaced nearly all, and nothing else."""
    rng = random.Random(length)
    say = sayer(rng)
    items = [(i, [f"q{length}x{i}x{k}" if k % 2 else rng.choice(["the", "of", f"v{rng.randrange(3000)}"]) for k in range(length)]) for i in range(30)]
    if length == 1:
        items = [(i, [f"single{i}"]) for i in range(30)]
    docs, copies, near = [], set(), set()
    for d in range(240):
        words, (i, item) = say(rng.randrange(3, 300)), items[d % len(items)]
        part = list(item)
        if d % 3 == 1 and length > 1:
            for k in rng.sample(range(length), int(length * 0.38)):
                part[k] = f"other{rng.randrange(1000)}"
        if d % 3 < 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
            (copies if part == item else near).add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(1000, " ".join(items[0][1])), (1001, items[1][1][0] + "!")]  # texts that are an item, or less than one
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    want = exhaustive(docs, [(i, " ".join(w)) for i, w in items])
    assert copies <= got and (1000, 0) in got and copies <= want
    assert len(got & near & want) >= 0.9 * len(near & want)
    assert got <= want | {(1000, 0), (1001, 1)}
