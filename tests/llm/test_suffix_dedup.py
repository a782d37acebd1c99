import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessitura.llm import suffix_dedup as S


def brute(rows, n=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + n] for _, b in texts for s in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone, end = bytearray(len(b)), 0
        for s in range(len(b) - n + 1):
            if count[b[s : s + n]] > 1:
                for p in range(max(s, end), s + n):
                    gone[p] = 1
                end = s + n
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def hard(seed):
    """Overlapping and periodic repeats, matches of 199 and 200 bytes, shifted copies, shared edges."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = text(500), text(300)
    rows = [text(50) + a[:200] + text(40), text(30) + a[:199] + text(20), text(10) + a[100:400] + text(5) + a[150:350], "xy" * 300, text(3) + "xy" * 150, a + b, b + a, b[:150] + a[:150], a[:250] + text(1) + a[251:], text(600), b, b]
    for _ in range(25):
        i, n = rng.randrange(200), rng.randrange(180, 300)
        rows.append(text(rng.randrange(80)) + a[i : i + n] + text(rng.randrange(80)))
    return list(enumerate(rows))


@pytest.mark.parametrize("hot, chunk", [(S.HOT, S.CHUNK), (2, 400), (S.HOT, 300)])
def test_against_brute_force(spark, rows, hot, chunk):
    for data in ([(r[0], r[1]) for r in rows], hard(2)):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
        assert sorted(tuple(r) for r in S.remove(df, hot=hot, chunk=chunk).collect()) == brute(data)


def test_trie_and_matches():
    rng = random.Random(7)
    for _ in range(50):
        word = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9)))
        pairs = [(word(), word()) for _ in range(rng.randrange(2, 9))]
        rights, lefts = [p[0] for p in pairs], [p[1] for p in pairs]
        got = S.deep(rights, lefts)
        for i in range(len(pairs)):
            for j in range(len(pairs)):
                if i != j:
                    left, right = S.common(lefts[i], lefts[j]), S.common(rights[i], rights[j])
                    assert any(x >= left and y >= right for x, y in got[i])


def test_empty_and_kept_text(spark, empty):
    assert S.remove(empty).count() == 0
    df = spark.createDataFrame([(1, "k" * 150 + "m" * 200 + "p"), (2, "m" * 200)], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in S.remove(df, with_text=True).collect()} == {1: b"k" * 150 + b"p", 2: b""}


def test_multikey_quicksort_orders_by_bytes():
    rng = random.Random(5)
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.choice((3, 20, 40)))).ljust(64, b"a") for _ in range(3000)] + [b"z" * 64] * 300
    keys = np.frombuffer(b"".join(rows), ">u8").reshape(-1, 8).astype(np.uint64)
    assert [rows[i] for i in S.multikey(keys)] == sorted(rows)
    assert S.multikey(keys[:0]).tolist() == [] and S.multikey(keys[:1]).tolist() == [0]


def test_one_line_in_every_text(spark):
    """A 64-byte string with another context in each text, hot and so dealt by context, beside true repeats."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, pair = text(120), text(260)
    rows = [(i, text(250) + line + text(250) + (pair if i % 40 == 0 else "")) for i in range(200)] + [(200, line + pair[:210]), (201, line + pair[:210] + "x"), (None, line + pair[:210])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = lambda r: (r[0] is None, *[x or 0 for x in r[:1]], *r[1:])
    want = sorted(brute([(-1 if i is None else i, t) for i, t in rows]))
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in S.remove(df, hot=20).collect())
    assert got == want


def test_ids_of_any_type_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "q" * 300, 1), ("a", "r" * 150, 2), (None, None, 3), ("a", "q" * 300, 1)], "doc_id string, text string, copies int")
    assert sorted((str(r[0]), r["n_bytes"], r["n_removed"]) for r in S.remove(df).collect()) == [("None", 0, 0), ("a", 150, 0), ("a", 300, 300), ("a", 300, 300)]
