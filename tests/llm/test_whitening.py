"""Whitening against plain arithmetic in whole numbers and numpy, and awkward vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tessitura.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors: list[tuple]) -> dict:
    """(vec_id, component): (n, deviation, whitened, explained), by plain loops."""
    good = [(k, [float(c) for c in v]) for k, v, _ in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    y = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x]) @ w
    return {(good[a][0], k + 1): (n, sum((n * r[i] - s[i]) ** 2 for i in range(d)), y[a, k] / math.sqrt(e[k]) if e[k] > 1e-9 else None, e[k] / np.trace(cov)) for a, r in enumerate(x) for k in range(min(32, d))}


def held(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, value, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["explained"] - explained) <= 1e-4 * max(explained, 1e-12)
        if value is None:
            assert r["whitened"] is None
            continue
        if abs(value) > 1e-3:
            assert sign.setdefault(r["component"], r["whitened"] * value > 0) == (r["whitened"] * value > 0)
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-7
        assert r["identity_error"] < 1e-9


def test_against_plain_arithmetic(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((90, 6)) @ rng.standard_normal((6, 6)) + [0, 5, -3, 0, 100, 0]
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(base)]
    rows += [(200, None, 1), (201, [None] + [0.5] * 5, 1), (202, [float("nan")] + [0.5] * 5, 1), (203, [float("inf")] + [0.5] * 5, 1), (204, [-float("inf")] * 6, 1), rows[0]]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(want) + 6  # the row that repeats
    held(got, want)


def test_more_dimensions_than_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(rng.standard_normal((120, 40)) * np.arange(1, 41))]
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_dimension_without_variance(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in (*v, 7.0)], 1) for i, v in enumerate(rng.standard_normal((50, 3)) * 4)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    held(got, brute(rows))
    assert sum(r["whitened"] is None for r in got) == 50


def test_sums_beyond_a_long(spark):
    """Huge entries: doubles are summed, deviations that fit no long are null."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(a) * 1e12, float(b) * 1e3], 1) for i, (a, b) in enumerate(rng.standard_normal((40, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 80 and all(r["deviation"] is None for r in got)
    assert max(r["identity_error"] for r in got) < 1e-4
    assert whitening.whiten(spark.createDataFrame([(1, [1e300], 1), (2, [-1e300], 1)], "vec_id long, embedding array<double>, label int")).count() == 2


def test_defined_cases(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 1)], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).count() == 0
    mixed = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1) for i in range(9)] + [(99, [1.0], 1)], SCHEMA).selectExpr("*", "1 as v", "2 as w", "3 as n", "4 as deviation")
    got = whitening.whiten(mixed).collect()
    assert {r["vec_id"] for r in got} == set(range(9)) and {r["n"] for r in got} == {9}


@pytest.mark.parametrize("d", [3, 9])
def test_pairs_in_several_aggregations(spark, d, monkeypatch):
    rng = np.random.default_rng(d)
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(rng.standard_normal((40, d)) * 3)]
    monkeypatch.setattr(whitening, "PAIRS_AT_ONCE", 4)
    held(whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))
