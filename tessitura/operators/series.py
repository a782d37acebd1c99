"""Operators over framewise series: rows (keys, frame, value), windows by (track, source).

A series is as long as its recording, so a window partition is bounded by that; series are
independent, and the windows of one query share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import clean, finite, num

KEYS = ["track", "source"]


def over(keys=KEYS, order="frame"):
    return Window.partitionBy(*keys).orderBy(order)


def flux(df: DataFrame, value: str = "value", keys=KEYS, order: str = "frame") -> DataFrame:
    """Adds ``flux``: the rise of log1p of the level, 0 at the first frame."""
    level = F.log1p(F.greatest(clean(F.col(value)), num(0)))
    return df.withColumn("_l", level).withColumn("flux", F.coalesce(F.greatest(F.col("_l") - F.lag("_l").over(over(keys, order)), num(0)), num(0))).drop("_l")


def rolling_median(x: str, half: int, keys=KEYS, order: str = "frame") -> Column:
    """Median of up to 2 half + 1 frames, fewer at the ends; nulls are skipped."""
    return F.percentile(x, num(0.5)).over(over(keys, order).rowsBetween(-half, half))


def with_quantile(df: DataFrame, name: str, x: str, fraction: float, keys: list[str]) -> DataFrame:
    """``df`` with ``name``: the quantile of ``x`` in the group, between two ranks lower * (1 - f) + upper * f, where the first product is not rounded before the sum.

    That is how the SQL's ``quantile_cont`` interpolates; ``percentile`` rounds both products, and its last bit decides levels that lie on a threshold.
    """
    whole = Window.partitionBy(*keys)
    df = df.withColumn("_rank", F.row_number().over(whole.orderBy(F.col(x).asc_nulls_last())) - 1).withColumn("_at", (F.count(x).over(whole) - 1) * num(fraction))
    ranked = lambda r: F.max(F.when(F.col("_rank") == r, F.col(x))).over(whole)
    df = df.withColumn("_lo", ranked(F.floor("_at"))).withColumn("_hi", ranked(F.ceil("_at")))
    f = F.col("_at") - F.floor("_at")
    between = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), "_lo", num(1) - f, F.col("_hi") * f).cast("double")
    return df.withColumn(name, F.when(F.col("_lo").isNotNull() & (f > 0), between).otherwise(F.col("_lo"))).drop("_rank", "_at", "_lo", "_hi")


def local_max(x: str, half: int, keys=KEYS, order: str = "frame") -> Column:
    return F.max(x).over(over(keys, order).rowsBetween(-half, half))


def spaced(df: DataFrame, separation: int, keys: list[str], better: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows at least ``separation`` frames from the last one kept, in the order of frames (then ``order``).

    A later row that is too near goes, or takes the place of the kept one if its ``better`` is greater.
    Rows fall into chains of near neighbours first, so what is folded at once is a few rows.
    """
    w = over(keys, "frame")
    rest = [c for c in df.columns if c not in (*keys, "frame", *order)]
    df = df.withColumn("_new", F.coalesce((F.col("frame") - F.lag("frame").over(w) >= separation).cast("int"), F.lit(1)))
    df = df.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = df.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(F.struct("frame", *order, *rest))).alias("_c"))
    last = lambda kept: F.element_at(kept, -1)

    def step(kept, x):
        instead = kept if better is None else F.when(x[better] > last(kept)[better], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x))).otherwise(kept)
        return F.when(x["frame"] - last(kept)["frame"] >= separation, F.concat(kept, F.array(x))).otherwise(instead)

    return chain.select(*keys, F.explode(F.aggregate("_c", F.slice("_c", 1, 1), step)).alias("_x")).select(*keys, "_x.*")


def peaks(df: DataFrame, half: int = 43, separation: int = 3, delta: float = 0.4, quantile: float = 0.9, keys=KEYS) -> DataFrame:
    """Frames inside the series whose flux is over the rolling median and the greatest around; of equal ones
    nearby the earliest, each counted from the one kept before; then those over the median by ``delta`` of the quantile of what is left."""
    df = df.withColumn("median", rolling_median("flux", half, keys)).withColumn("_top", local_max("flux", separation, keys))
    all_of = Window.partitionBy(*keys)
    df = df.withColumn("_n", F.count("*").over(all_of)).withColumn("_i", F.row_number().over(over(keys)) - 1)
    cand = df.filter((F.col("flux") > F.col("median")) & (F.col("flux") >= F.col("_top")) & (F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1))
    cand = spaced(cand.select(*keys, "frame", "flux", "median"), separation, list(keys), "flux")
    cand = cand.withColumn("_q", F.percentile("flux", num(quantile)).over(all_of))
    return cand.filter((F.col("_q") > 0) & (F.col("flux") > F.col("median") + num(delta) * F.col("_q"))).select(*keys, "frame", "flux", "median")


def first_onset(df: DataFrame, fraction: float = 0.2, keys=KEYS) -> DataFrame:
    """First frame whose flux reaches a fraction of the greatest."""
    top = F.max("flux").over(Window.partitionBy(*keys))
    return df.withColumn("_top", top).filter((F.col("_top") > 0) & (F.col("flux") >= num(fraction) * F.col("_top"))).groupBy(*keys).agg(F.min("frame").alias("frame"))


def intervals(df: DataFrame, t: str, keys: list[str], outlier: float = 4.0) -> DataFrame:
    """Positive gaps between neighbours (``ioi``), without those beyond ``outlier`` times the median either way."""
    gaps = df.withColumn("ioi", F.col(t) - F.lag(t).over(over(keys, t))).filter("ioi > 0")
    gaps = gaps.withColumn("_m", F.percentile("ioi", num(0.5)).over(Window.partitionBy(*keys)))
    return gaps.filter((F.col("ioi") >= F.col("_m") / num(outlier)) & (F.col("ioi") <= F.col("_m") * num(outlier))).drop("_m")


def runs(df: DataFrame, value: str, keys=KEYS, order: str = "frame") -> DataFrame:
    """Gaps and islands: (keys, run, value, first, last, n) of stretches with one value; a gap in ``order`` splits."""
    w = over(keys, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col(order) - F.lag(order).over(w) != 1) | F.lag(order).over(w).isNull()
    df = df.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return df.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def near(df: DataFrame, flag: Column, reach: int, keys: list[str], order: str = "frame") -> Column:
    """Whether a flagged row lies within ``reach`` of this one in ``order``: a range semi-join without a join."""
    return F.coalesce(F.max(F.when(flag, 1).otherwise(0)).over(over(keys, order).rangeBetween(-reach, reach)) == 1, F.lit(False))


def nearest_peak(times: DataFrame, env: DataFrame, reach: int, hop: float, keys=KEYS, value: str = "value", t: str = "t") -> DataFrame:
    """``times`` (keys, t, ...) with ``peak_frame`` and ``peak``: the greatest value of ``env`` (keys, frame, value) within ``reach`` frames of the time's nearest one.

    Of equal values the earlier counts. Null where the envelope has no such frame, or nothing above zero around it. The greatest around
    each frame is a window over the envelope, so a time is one equi-join on its frame.
    """
    around = over(keys).rangeBetween(-reach, reach)
    best = F.max(F.when(finite(F.col(value)), F.struct(F.col(value).alias("v"), (-F.col("frame")).alias("f")))).over(around)
    tops = env.select(*keys, F.col("frame").alias("_frame"), best.alias("_b"))
    at = times.withColumn("_frame", F.rint(F.col(t) / num(hop)).cast("long"))
    out = at.join(tops, [*keys, "_frame"], "left")
    found = F.col("_b.v") > 0
    return out.withColumn("peak_frame", F.when(found, -F.col("_b.f"))).withColumn("peak", F.when(found, F.col("_b.v"))).drop("_frame", "_b")


def octave_snap(df: DataFrame, midi: str, half: int = 10, keys=KEYS) -> DataFrame:
    """Moves a pitch by whole octaves towards the running median where that is strictly nearer."""
    df = df.withColumn("_m", rolling_median(midi, half, keys))
    k = F.rint((F.col("_m") - F.col(midi)) / num(12))
    moved = F.col(midi) + num(12) * k
    better = (k != 0) & (F.abs(moved - F.col("_m")) < F.abs(F.col(midi) - F.col("_m")))
    return df.withColumn("snapped", F.when(better, moved).otherwise(F.col(midi))).withColumn("moved", F.coalesce(better, F.lit(False))).drop("_m")


def cosine(a: Column, b: Column) -> Column:
    """Null where either norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, num(0), lambda s, x: s + x * x))
    return dot / F.nullif(norm(a) * norm(b), num(0))


def interval_sums(values: DataFrame, spans: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """Sum of ``value`` over frames [start, end) of each span, by two equi-joins with prefix sums."""
    w = over(keys).rowsBetween(Window.unboundedPreceding, -1)
    upto = values.select(*keys, "frame", F.coalesce(F.sum(value).over(w), num(0)).alias("_c"))
    last = values.groupBy(*keys).agg((F.max("frame") + 1).alias("frame"), F.sum(value).alias("_c"))
    upto = upto.unionByName(last)
    a = upto.withColumnsRenamed({"frame": "start", "_c": "_a"})
    b = upto.withColumnsRenamed({"frame": "end", "_c": "_b"})
    return spans.join(a, [*keys, "start"]).join(b, [*keys, "end"]).withColumn("total", F.col("_b") - F.col("_a")).drop("_a", "_b")


def relative_mad(x: str) -> tuple[Column, Column]:
    """Median, and the expression for the second pass: mean absolute deviation from it over it."""
    return F.percentile(x, num(0.5)), F.percentile(F.abs(F.col(x) - F.col("_m")), num(0.5)) / F.nullif(F.first("_m"), num(0))


def place() -> Column:
    """Where a row stands in the files it is read from."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_mean_in_order(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """``rows`` with each column replaced by its mean in the group, summed from the row with the smallest ``at`` on; nulls are skipped.

    A sum of doubles depends on its order, so a mean next to a threshold would depend on how the input is split. This one doesn't.
    """
    whole = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({c: F.avg(c).over(whole) for c in columns})


def averages(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, columns): number of rows and means of each group of a table as it was read, summed in the order of its rows."""
    means = with_mean_in_order(rows.select(*keys, *columns, place().alias("_at")), keys, "_at", columns)
    return means.groupBy(*keys).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in columns])
