"""Key estimation by correlation with rotated pitch-class profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import NOTE_NAMES, finite, num

#: The published probe-tone profiles, from the tonic on.
PROFILES = {
    "major": [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88],
    "minor": [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17],
}


def rotated(profile: list[float], tonic: int) -> list[float]:
    """The profile by pitch class from c on, for a tonic."""
    return [profile[(i - tonic) % 12] for i in range(12)]


def _templates() -> list[tuple[str, str, list[float]]]:
    """(key, scale, profile centred and of unit length) of the 24 candidates."""
    out = []
    for scale, p in PROFILES.items():
        mean = sum(p) / 12
        norm = sum((x - mean) ** 2 for x in p) ** 0.5
        out += [(n, scale, [(x - mean) / norm for x in rotated(p, i)]) for i, n in enumerate(NOTE_NAMES)]
    return out


#: The pitches that count, in Hz, and over how many semitones a peak spreads.
PEAK_HZ, SPREAD = (40.0, 5000.0), 4 / 3


def peak_classes(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chroma) from spectral peaks (keys, hz, magnitude): power by pitch class from c on, the greatest 1.

    A peak gives its power to each class that is nearer than half of ``SPREAD`` semitones, by the squared cosine of its distance.
    """
    p = peaks.filter((F.col("hz") >= PEAK_HZ[0]) & (F.col("hz") <= PEAK_HZ[1]) & finite(F.col("magnitude")) & (F.col("magnitude") > 0))
    p = p.withColumn("_m", num(69) + num(12) * F.log2(F.col("hz") / num(440)))
    sums = []
    for i in range(12):
        off = F.pmod(F.col("_m") - num(i) + num(6), num(12)) - num(6)
        weight = F.cos(num(math.pi / SPREAD) * off)
        sums.append(F.sum(F.when(F.abs(off) <= num(SPREAD / 2), weight * weight * F.col("magnitude") * F.col("magnitude")).otherwise(num(0))).alias(f"_{i}"))
    a = p.groupBy(*keys).agg(*sums).withColumn("_top", F.greatest(*[F.col(f"_{i}") for i in range(12)])).filter("_top > 0")
    return a.select(*keys, F.array(*[F.col(f"_{i}") / F.col("_top") for i in range(12)]).alias("chroma"))


def estimate_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, scale, strength, confidence) from ``chroma``, an array of 12: the best of 24
    candidates by correlation; confidence is the correlation times its lead over the best other tonic,
    as a share of the whole range. Nothing for a chroma that isn't 12 finite numbers or doesn't vary."""
    c = F.col("chroma")
    df = df.filter((F.size(c) == 12) & F.forall(c, finite))
    total = lambda a: F.aggregate(a, num(0), lambda s, x: s + x)
    df = df.withColumn("_m", total(c) / num(12)).withColumn("_c", F.transform(c, lambda x: x - F.col("_m")))
    df = df.withColumn("_n", F.sqrt(total(F.transform("_c", lambda x: x * x)))).filter("_n > 0")
    templates = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.array(*[num(x) for x in w]).alias("w")) for k, s, w in _templates()])
    dot = lambda w: total(F.zip_with("_c", w, lambda x, y: x * y)) / F.col("_n")
    df = df.withColumn("_r", F.transform(templates, lambda t: F.struct(dot(t["w"]).alias("r"), t["k"].alias("k"), t["s"].alias("s"))))
    df = df.filter(F.forall("_r", lambda x: finite(x["r"])))
    df = df.withColumn("_b", F.array_max("_r")).withColumn("_w", F.array_min("_r")["r"])
    rival = F.array_max(F.filter("_r", lambda x: x["k"] != F.col("_b")["k"]))["r"]
    clip = lambda x: F.least(num(1), F.greatest(num(0), x))
    lead = F.when(F.col("_b.r") > F.col("_w"), clip(F.col("_b.r")) * clip((F.col("_b.r") - rival) / (F.col("_b.r") - F.col("_w"))))
    return df.select(*keys, F.col("_b.k").alias("key"), F.col("_b.s").alias("scale"), F.col("_b.r").alias("strength"), lead.alias("confidence"))
