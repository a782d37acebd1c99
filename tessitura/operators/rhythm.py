"""Onsets, beats and rhythm descriptors from the frames of a recording."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import num
from tessitura.operators import series, tempo
from tessitura.operators.degrade import guarded, schema
from tessitura.operators.downbeat import beat_offsets

#: Fixed values.
STRENGTH_FLOOR, TRUSTED_RATE, SHARPEST, WINDOW, RELATIVE = 0.5, 0.5, 100.0, 43, 0.07
SLOWEST, FASTEST, USUAL = 60.0, 200.0, 120.0


def onsets(frames: DataFrame, keys: list[str], value: str = "power") -> DataFrame:
    """(keys, frame, flux, median): peaks of the onset strength that stand out by a fourteenth of the greatest;
    none where it never reaches ``STRENGTH_FLOOR``."""
    f = series.flux(frames, value, keys)
    most = f.groupBy(*keys).agg(F.max("flux").alias("_most")).filter(F.col("_most") >= STRENGTH_FLOOR)
    found = series.peaks(f.join(most.select(*keys), keys, "left_semi"), WINDOW, keys=keys)
    return found.join(most, keys).filter(F.col("flux") > F.col("median") + num(RELATIVE) * F.col("_most")).drop("_most")


def describe(frames: DataFrame, found: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """(keys, seconds, onset_density, transient_sharpness): onsets a second, and how far they stand over the median around."""
    length = frames.groupBy(*keys).agg((F.count("*") * num(hop)).alias("seconds"))
    over = F.when(F.col("median") > 0, F.least(num(SHARPEST), F.col("flux") / F.col("median"))).otherwise(num(SHARPEST))
    o = found.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(over).alias("transient_sharpness"))
    return length.join(o, keys, "left").select(*keys, "seconds", (F.coalesce("_n", F.lit(0)) / F.col("seconds")).alias("onset_density"), "transient_sharpness")


def likely_bpm(flux: np.ndarray, hop: float) -> tuple[float | None, float]:
    """The tempo from 60 to 200 whose beat correlates most, weighed towards 120; and that correlation."""
    r = tempo.autocorrelation(flux)
    low, high = max(1, math.floor(60 / FASTEST / hop)), math.ceil(60 / SLOWEST / hop)
    if len(r) < 2 * high or not r.any():
        return None, 0.0
    lags = np.arange(low, high + 1)
    weight = np.exp(-0.5 * np.log2(60 / (lags * hop) / USUAL) ** 2)
    i = low + int(np.argmax(r[low : high + 1] * weight))
    return 60 / (tempo.refine_peak(r, i) * hop), float(r[i])


def coarse_tempo(frames: DataFrame, keys: list[str], hop: float, value: str = "power") -> DataFrame:
    """(keys, bpm, r, error) of each recording; one group is one recording, so its size is bounded by that."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bpm, r = likely_bpm(pdf.sort_values("frame")["flux"].to_numpy(float), hop)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "bpm": bpm, "r": r}])

    f = series.flux(frames, value, keys).select(*keys, "frame", "flux")
    return f.groupBy(*keys).applyInPandas(guarded(run, keys, {"bpm": None, "r": None}), schema(frames, keys, "bpm double, r double"))


def trusted(tempos: DataFrame, described: DataFrame, keys: list[str]) -> DataFrame:
    """Tempos, null where there is less than an onset in two seconds."""
    t = tempos.join(described.select(*keys, "onset_density"), keys)
    return t.withColumn("bpm", F.when(F.col("onset_density") >= TRUSTED_RATE, F.col("bpm"))).drop("onset_density")


def beats(frames: DataFrame, tempos: DataFrame, keys: list[str], hop: float, value: str = "power") -> DataFrame:
    """(keys, beat, t): beat times at the tempo's period from the best phase on."""
    f = series.flux(frames, value, keys)
    periods = tempos.filter("bpm is not null").select(*keys, (num(60) / F.col("bpm")).alias("period_seconds"))
    phase = beat_offsets(f, periods, keys, hop).join(periods, keys)
    last = frames.groupBy(*keys).agg((F.max("frame") * num(hop)).alias("_last"))
    b = phase.join(last, keys).withColumn("_at", F.col("offset") * num(hop)).filter(F.col("_last") >= F.col("_at"))
    b = b.withColumn("beat", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_last") - F.col("_at")) / F.col("period_seconds")))))
    return b.select(*keys, "beat", (F.col("_at") + F.col("beat") * F.col("period_seconds")).alias("t"))
