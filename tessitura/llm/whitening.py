"""Whitening of embeddings (operator 12).

One aggregation sums, for every pair of dimensions on or above the diagonal, the product of the centred
entries, as SQL expressions generated from the dimensions. Entries are whole numbers, so they are centred
by the whole number next to their mean and the sums stay exact; the rest of the mean is settled on the driver in
whole numbers too. Of the covariance (dimensions squared, whatever the number of rows) LAPACK makes eigenvectors, and
each row is projected in Arrow batches. What comes out is measured by a second aggregation of the same kind.

Defined cases: a null vector and one with a null or non-finite entry is dropped, and so is one whose length isn't
the most common (of equally common ones the longer); repeated rows count each; entries beyond 2^62 are taken as
2^62; a deviation that exceeds a long is null; a component without variance has null in ``whitened`` and no part in
``identity_error``; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.session import materialize

#: Fixed by the contract.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries are held within this bound.
BOUND = 1 << 62
#: Expressions in one aggregation; wider vectors take several.
PAIRS_AT_ONCE = 8192


def finite(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v): the vectors whose entries are all there and finite, as doubles."""
    v = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    return v.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def whole(c: Column) -> Column:
    low = F.greatest(F.least(F.floor(c * float(SCALE)), F.lit(BOUND)), F.lit(-BOUND))
    return low + F.lit(OFFSET)


def _columns(v: DataFrame, d: int) -> DataFrame:
    return v.select(*[whole(F.get("v", i)).alias(f"x{i}") for i in range(d)])


@dataclass(frozen=True)
class Fit:
    """n vectors; per dimension a whole centre and the rest of n times the mean; eigenvalues, components and the trace."""

    n: int
    centre: list[int]
    rest: list[int]
    reach: int
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Which components have variance, beyond what rounding leaves."""
        return self.eigenvalues > max(self.trace, 0.0) * 1e-13


def products(columns: DataFrame, centred: list[Column]) -> np.ndarray:
    """Matrix of the sums of products of every pair, from the upper triangle in one aggregation."""
    d = len(centred)
    rows = columns.select(*[c.alias(f"z{i}") for i, c in enumerate(centred)])
    pairs, out = [(i, j) for i in range(d) for j in range(i, d)], np.zeros((d, d), object)
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[at : at + PAIRS_AT_ONCE]
        got = rows.agg(*[F.expr(f"sum(z{i} * z{j})") for i, j in some]).first()
        for (i, j), s in zip(some, got, strict=True):
            out[i, j] = out[j, i] = s
    return out


def fit(v: DataFrame) -> Fit | None:
    """Eigenvectors of the covariance of ``v``; None without vectors."""
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    n, d = lengths[0]["count"], lengths[0]["d"]
    x = _columns(v.filter(F.size("v") == d), d)
    ends = x.agg(*[f(f"x{i}") for i in range(d) for f in (lambda c: F.sum(F.col(c).cast("decimal(19,0)")), F.min, F.max)]).first()
    sums = [int(s) for s in ends[::3]]
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    reach = max(max(abs(lo - m), abs(hi - m)) for lo, hi, m in zip(ends[1::3], ends[2::3], centre, strict=True))
    exact = n * reach * reach < 1 << 63
    z = [F.col(f"x{i}") - F.lit(m) if exact else F.col(f"x{i}").cast("double") - F.lit(float(m)) for i, m in enumerate(centre)]
    both = products(x, z)
    if exact:  # whole numbers to the last division
        cov = np.array([[float(Fraction(n * int(both[i, j]) - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    else:
        r = np.array(rest, float) / n
        cov = both.astype(float) / n - np.outer(r, r)
    e, w = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[: min(COMPONENTS, d)]
    w = w[:, order]
    w = w * np.where(w[np.abs(w).argmax(0), np.arange(w.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    return Fit(n, centre, rest, reach, e[order], w, float(np.trace(cov)))


def project(v: DataFrame, model: Fit, key: str = "vec_id") -> DataFrame:
    """(key, deviation, w) of every vector of the fitted length: its exact squared deviation and whitened components."""
    n, d, usable = model.n, len(model.centre), model.usable
    rest, scale = np.array(model.rest, float) / n, np.where(usable, 1 / np.sqrt(np.where(usable, model.eigenvalues, 1.0)), 0.0)
    into, k = model.components * scale, len(usable)
    fits = d * (n * model.reach + n) ** 2 < 1 << 63
    centre = np.array(model.centre, np.int64)
    kind = v.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            with np.errstate(over="ignore"):
                z = np.clip(np.floor(c * SCALE), -BOUND, BOUND).astype(np.int64) + OFFSET - centre
            if fits:
                deviation = pa.array(((n * z - np.array(model.rest, np.int64)) ** 2).sum(1))
            else:
                sums = [sum((n * int(a) - r) ** 2 for a, r in zip(row, model.rest, strict=True)) for row in z]
                deviation = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
            w = (z - rest) @ into
            gone = np.broadcast_to(~usable, w.shape).ravel()
            w = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * k + 1, k), pa.int32()), pa.array(w.ravel(), mask=gone))
            yield pa.RecordBatch.from_arrays([batch.column(key), deviation, w], names=[key, "deviation", "w"])

    return v.filter(F.size("v") == d).mapInArrow(run, f"`{key}` {kind}, deviation bigint, w array<double>")


def identity_error(projected: DataFrame, model: Fit) -> float | None:
    """The largest entry of the covariance of the whitened vectors minus the identity, measured on all of them."""
    some = [int(i) for i in np.flatnonzero(model.usable)]
    if not some:
        return None
    w = projected.select(*[F.get("w", i).alias(f"w{i}") for i in some])
    means = w.agg(*[F.avg(f"w{i}") for i in some]).first()
    cov = products(w, [F.col(f"w{i}") - F.lit(m) for i, m in zip(some, means, strict=True)]).astype(float) / model.n
    return float(np.abs(cov - np.eye(len(some))).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each vector and component."""
    v = finite(vectors, key, vector)
    kind = v.schema[key].dataType.simpleString()
    model = fit(v)
    if model is None:
        return v.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    rows = materialize(project(v, model, key), "whitened")
    error = identity_error(rows, model)
    share = F.lit([float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues]).cast("array<double>")
    out = rows.select(key, "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(key, (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return whiten(table(spark, sf_dir, "embeddings"))
