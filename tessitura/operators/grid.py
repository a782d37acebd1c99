"""Folding onto cycles and steps: profiles, contrast, phase, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import num


def fold(df: DataFrame, t: Column, cycle: float, anchor: float, slots: int, value: str, keys: list[str], min_cycles: int = 2) -> DataFrame:
    """(keys, cycle, slot, level): the greatest value at each slot of each whole cycle, 0 where
    none fell. Times go to the nearest slot; those before the anchor and the last, partial cycle go."""
    k = F.rint((t - num(anchor)) / num(cycle / slots)).cast("long")
    hit = df.withColumn("_k", k).filter("_k >= 0").groupBy(*keys, "_k").agg(F.max(value).alias("level"))
    many = hit.groupBy(*keys).agg(F.floor((F.max("_k") + 1) / slots).alias("_cycles")).filter(F.col("_cycles") >= min_cycles)
    dense = many.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cycles") * slots - 1))).drop("_cycles")
    out = dense.join(hit, [*keys, "_k"], "left")
    return out.select(*keys, F.floor(F.col("_k") / slots).alias("cycle"), F.pmod("_k", F.lit(slots)).alias("slot"), F.greatest(F.coalesce("level", num(0)), num(0)).alias("level"))


def profile(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Median over the cycles at each slot."""
    return folded.groupBy(*keys, "slot").agg(F.percentile("level", num(0.5)).alias("level"))


def contrast(prof: DataFrame, keys: list[str], oversample: int = 1) -> DataFrame:
    """1 - mean / peak of a profile, and the share of it that lies on step centres."""
    out = prof.groupBy(*keys).agg(F.max("level").alias("_p"), F.avg("level").alias("_m"), F.sum("level").alias("_s"), F.sum(F.when(F.pmod("slot", F.lit(oversample)) == 0, F.col("level"))).alias("_on"))
    return out.select(*keys, F.when(F.col("_p") > 0, num(1) - F.col("_m") / F.col("_p")).otherwise(num(0)).alias("contrast"), (F.col("_on") / F.nullif(F.col("_s"), num(0))).alias("on_grid"))


def phase(fraction: Column) -> tuple[Column, Column]:
    """Aggregates: circular mean of residuals in steps, and their mean absolute size."""
    angle = num(6.283185307179586) * fraction
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))) / num(6.283185307179586), F.avg(F.abs(fraction))


def occupancy(hits: DataFrame, keys: list[str], step: str, cycle: str) -> DataFrame:
    """Share of the cycles in which anything plays that have a hit on each step."""
    playing = hits.groupBy(*keys).agg(F.countDistinct(cycle).alias("_all"))
    return hits.groupBy(*keys, step).agg(F.countDistinct(cycle).alias("_n")).join(playing, keys).select(*keys, step, (F.col("_n") / F.col("_all")).alias("occupancy"))


def beat_phase(df: DataFrame, period: float, value: str, keys: list[str]) -> DataFrame:
    """(keys, offset, contrast): the offset in the period with the greatest mean; ties go to the smallest."""
    offsets = max(1, round(period))
    marked = df.withColumn("_offset", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    k = F.rint((F.col("frame") - F.col("_offset")) / num(period))
    on = marked.filter((k >= 0) & (F.rint(F.col("_offset") + k * num(period)) == F.col("frame")))
    means = on.groupBy(*keys, "_offset").agg(F.avg(value).alias("_m"))
    best = means.groupBy(*keys).agg(F.max_by("_offset", F.struct("_m", -F.col("_offset"))).alias("offset"), F.max("_m").alias("_p"), (F.sum("_m") / num(offsets)).alias("_a"))
    return best.filter("_p > 0").select(*keys, "offset", F.greatest(num(0), num(1) - F.col("_a") / F.col("_p")).alias("contrast"))
