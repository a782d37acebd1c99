"""The manifest against plain folding, and its awkward rows."""

import hashlib
import random
import zlib

import pytest

from tessitura.llm import merkle
from tests.llm.conftest import DOCS


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text) -> str:
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(value(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], int]]]]:
    """The root, and per node its siblings and place at each level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for i, a in enumerate(at):
            run = now[a // 16 * 16 : a // 16 * 16 + 16]
            paths[i].append((run[: a % 16] + run[a % 16 + 1 :], a % 16))
        now = [H("".join(now[i : i + 16])) for i in range(0, len(now), 16)]
        at = [a // 16 for a in at]
    return now[0], paths


def folded(node: str, path) -> str:
    for others, place in path:
        node = H("".join([*others[:place], node, *others[place:]]))
    return node


def brute(rows: list[dict]) -> list[tuple]:
    leaves = [(r, leaf(r, r["text"])) for r in rows]
    by: dict = {}
    for r, x in leaves:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, x, r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, tops = tree([trees[s][0] for s in names]) if names else ("", [])
    out = []
    for k, s in enumerate(names):
        for (_, _, x, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            path = path + tops[k]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            lower = None if r["text"] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"])
            top = folded(leaf(r, lower) if hit else x, path)
            out.append((r["doc_id"], x, trees[s][0], root, H("".join("".join(others) for others, _ in path)), top, top == root))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    return sorted([tuple(r) for r in merkle.manifest(df).collect()], key=str)


def as_dicts(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


def test_awkward_rows(spark, rows):
    """Null, empty, long and repeated rows, null ids and a null source."""
    more = [*rows, (None, "No Id", "en", "s1", 5), (None, None, None, None, None), rows[0]]
    assert run(spark, more) == brute(as_dicts(more))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_ends_of_levels(spark, n):
    rows = [(i, f"Text {i}", "en", "a", i) for i in range(n)]
    assert run(spark, rows, 2) == brute(as_dicts(rows))


def test_blocks_and_sources(spark):
    """A source over several blocks, the last one of a single leaf, and more sources than one node holds."""
    rng = random.Random(5)
    rows = [(i, f"Tx {rng.random()}", "en", "hot", i) for i in range(2 * merkle.BLOCK + 1)]
    rows += [(10**6 + i, "x", None, f"é{i % 20}", None) for i in range(60)]
    assert run(spark, rows, 4) == brute(as_dicts(rows))


def test_tampering_shows(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "a", 5) for i in range(60)]
    for r in run(spark, rows):
        assert r[6] == (not (zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2 == 1))


def test_empty_and_extra_columns(spark, empty, docs):
    assert merkle.manifest(empty).count() == 0
    wide = docs.selectExpr("*", "1 as pos", "'x' as leaf", "2 as n", "3 as _id", "4 as srank")
    assert sorted(map(str, merkle.manifest(wide).collect())) == sorted(map(str, merkle.manifest(docs).collect()))
