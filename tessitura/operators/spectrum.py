"""Descriptors of power by frequency: rows (keys, freq, power)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import num

#: The shared bands in Hz; the last is closed above.
BANDS = [("low", 20.0, 250.0), ("low_mid", 250.0, 2000.0), ("high_mid", 2000.0, 6000.0), ("high", 6000.0, 20000.0)]
BRIGHT_HZ = 1500.0
ROLLOFF = 0.85


def in_band(freq, low: float, high: float, closed: bool = False):
    return (freq >= low) & ((freq <= high) if closed else (freq < high))


def describe(df: DataFrame, keys: list[str], bands=BANDS, bright: float = BRIGHT_HZ) -> DataFrame:
    """Band ratios, brightness and centroid, in one aggregation; all null without energy in the bands."""
    f, p = F.col("freq"), F.col("power")
    inside = in_band(f, bands[0][1], bands[-1][2], True)
    sums = [F.sum(F.when(in_band(f, lo, hi, i == len(bands) - 1), p).otherwise(num(0))).alias(f"_{n}") for i, (n, lo, hi) in enumerate(bands)]
    out = df.filter(inside).groupBy(*keys).agg(*sums, F.sum(p).alias("_t"), F.sum(F.when(f >= bright, p).otherwise(num(0))).alias("_b"), F.sum(f * p).alias("_fp"))
    t = F.nullif(F.col("_t"), num(0))
    return out.select(*keys, *[(F.col(f"_{n}") / t).alias(n) for n, _, _ in bands], (F.col("_b") / t).alias("brightness"), (F.col("_fp") / t).alias("centroid"))


def energy_percentile(df: DataFrame, keys: list[str], share: float = ROLLOFF) -> DataFrame:
    """The first frequency at which the cumulated power reaches a share of the whole."""
    w = Window.partitionBy(*keys).orderBy("freq")
    df = df.withColumn("_c", F.sum("power").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("power").over(Window.partitionBy(*keys)))
    return df.filter((F.col("_t") > 0) & (F.col("_c") >= num(share) * F.col("_t"))).groupBy(*keys).agg(F.min("freq").alias("rolloff"))


#: Fixed value: how far below its peak bin a spectrum is read.
FLATNESS_FLOOR = 1e-12


def flatness(power: Column) -> Column:
    """Geometric over arithmetic mean of an array of power, each bin no lower than FLATNESS_FLOOR of the greatest; null for silence."""
    top = F.array_max(power)
    floored = F.transform(power, lambda p: F.greatest(p, top * num(FLATNESS_FLOOR)))
    mean = lambda a: F.aggregate(a, num(0), lambda s, x: s + x) / F.size(a)
    return F.when(top > 0, F.exp(mean(F.transform(floored, lambda p: F.ln(p)))) / mean(floored))
