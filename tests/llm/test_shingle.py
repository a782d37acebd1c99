import random

import numpy as np
import pyarrow as pa

from tessitura.llm import shingle as S


def test_words_are_those_of_split_whatever_the_pieces():
    rng = random.Random(3)
    alphabet = ["a", "B", "c", "é", "\0", " ", "\t", "\n", "\v", "\x1c", "\x85", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += [None, "", "x" * 200_000, " " * 70_000, ("ab " * 50_000) + "end", "end", "y" * 65_536, "z"]
    rng.shuffle(texts)
    column = pa.array(["skipped", *texts], pa.string())[1:]
    hashes, ends = S.hash_words(column)
    known: dict[bytes, int] = {}
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        words = (t or "").encode().lower().split()
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert S.hash_words(pa.array([], pa.string()))[1].tolist() == [0]
    assert S.hash_words(pa.array([None], pa.string()))[1].tolist() == [0, 0]


def test_sets_and_windows():
    words = np.arange(40_000, dtype=np.uint64)
    assert np.array_equal(S.windows(words, 5), S.windows(words, 5, block=777))
    sets = S.shingle_sets(pa.array(["a b c d e f", "A b  c d e f", "a b c", "c b a", None, "a a a a a a a"]))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 1] and np.array_equal(sets[0], sets[1]) and sets[2] != sets[3]


def test_parts_lose_no_row():
    texts = ["a" * 50, None, "", "b" * 500, "c", None] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(42))], names=["text", "i"])
    for most in (1, 60, 600, 10**6):
        got = list(S.parts(iter([batch, batch.slice(0, 0), batch.slice(3)]), most))
        assert [x for b in got for x in b.column("i").to_pylist()] == list(range(42)) + list(range(3, 42))
    assert S.parts(iter([batch.slice(0, 0)])).__next__().num_rows == 0
