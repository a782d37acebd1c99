"""Tempo to grid grade: autocorrelation of an onset envelope, several beat multiples, octaves, halves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.degrade import guarded, schema

#: Fixed values.
MULTIPLES, OCTAVES = (16, 32), (0.5, 1.0, 2.0)
WINDOW_BEATS, HALF, TOLERANCE, AGREEMENT, MIN_R = 0.45, 3, 0.03, 0.05, 0.15
HIGH_R, MEDIUM_R, STABLE_HIGH, STABLE_MEDIUM = 0.50, 0.25, 0.05, 0.50


def nearest_candidate(x: Column, candidates: list[int], cycle: int) -> Column:
    """The candidate at the least circular distance; ties go to the earlier."""
    rows = [F.struct(F.least(F.abs(x - c), F.lit(cycle) - F.abs(x - c)).alias("d"), F.lit(c).alias("c")) for c in candidates]
    return F.array_min(F.array(*rows))["c"]


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Biased, of the centred series, 1 at lag 0; zeros if it doesn't vary."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    size = 1 << math.ceil(math.log2(max(4, 2 * n)))
    spectrum = np.abs(np.fft.rfft(x - x.mean(), size)) ** 2
    r = np.fft.irfft(spectrum, size)[:n]
    return r / r[0] if r[0] > 0 and np.isfinite(r[0]) else np.zeros(n)


def refine_peak(r: np.ndarray, i: int) -> float:
    """Centre of mass of the peak over its own floor."""
    if i < HALF or i + HALF >= len(r):
        return float(i)
    lobe = r[i - HALF : i + HALF + 1]
    lobe = lobe - lobe.min()
    return float(i + (lobe @ np.arange(-HALF, HALF + 1)) / lobe.sum()) if lobe.sum() > 0 else float(i)


def fit(r: np.ndarray, hop: float, coarse: float, beats: int) -> dict:
    """What one beat multiple says: bpm, r, and why it was refused if it was."""
    target, width = beats * 60.0 / coarse / hop, min(TOLERANCE, WINDOW_BEATS / beats)
    low, high = max(1, math.floor(target * (1 - width))), math.ceil(target * (1 + width))
    out = {"beats": beats, "bpm": None, "r": 0.0, "reason": "too_short"}
    if high <= low or high > len(r) // 2 - HALF - 1:
        return out
    i = low + int(np.argmax(r[low : high + 1]))
    out["r"] = max(0.0, float(r[i]))
    if r[i] < MIN_R:
        return out | {"reason": "below_correlation_floor"}
    out["bpm"] = 60.0 * beats / (refine_peak(r, i) * hop)
    return out | {"reason": None if abs(out["bpm"] - coarse) / coarse <= TOLERANCE else "outside_bpm_tolerance"}


def combine(fits: list[dict]) -> tuple[float | None, float]:
    """Mean of the accepted readings if they agree; a single one is never of high confidence."""
    ok = [f for f in fits if f["reason"] is None]
    if not ok:
        return None, 0.0
    weakest = min(f["r"] for f in ok)
    if len(ok) < len(MULTIPLES):
        return ok[0]["bpm"], min(weakest, HIGH_R - 1e-9)
    bpms = [f["bpm"] for f in ok]
    return (None if max(bpms) - min(bpms) > AGREEMENT else float(np.mean(bpms))), weakest


def measure(x: np.ndarray, hop: float, coarse: float) -> dict:
    """Tempo, octave status and stability of one envelope."""
    if not (math.isfinite(coarse) and coarse > 0):
        return dict(UNAVAILABLE)
    r = autocorrelation(x)
    bpm, weakest = combine([fit(r, hop, coarse, m) for m in MULTIPLES])
    octaves = {o: fit(r, hop, coarse * o, MULTIPLES[0]) for o in OCTAVES}
    live = {o: f["reason"] != "too_short" and f["r"] >= MIN_R for o, f in octaves.items()}
    octave = "unavailable" if octaves[1.0]["reason"] == "too_short" else "ambiguous" if live[0.5] or live[2.0] else "single"
    stability, half = "unknown", len(x) // 2
    if half >= 4:
        sides = [{m: fit(s, hop, coarse, m) for m in MULTIPLES} for s in (autocorrelation(x[:half]), autocorrelation(x[half:]))]
        both = [m for m in MULTIPLES if all(s[m]["reason"] is None for s in sides)]
        if both:
            a, b = (np.mean([s[m]["bpm"] for m in both]) for s in sides)
            stability = "high" if abs(a - b) <= STABLE_HIGH else "medium" if abs(a - b) <= STABLE_MEDIUM else "low"
    if bpm is None:
        return {"bpm": coarse, "status": "coarse", "r": 0.0, "confidence": "low", "octave": octave, "stability": stability}
    return {"bpm": bpm, "status": "refined", "r": weakest, "confidence": "high" if weakest >= HIGH_R else "medium" if weakest >= MEDIUM_R else "low", "octave": octave, "stability": stability}


TEMPO = "bpm double, status string, r double, confidence string, octave string, stability string"


UNAVAILABLE = {"bpm": None, "status": "unavailable", "r": 0.0, "confidence": "low", "octave": "unavailable", "stability": "unknown"}


def refine(df: DataFrame, keys: list[str], hop: float, value: str = "flux", coarse: str = "coarse") -> DataFrame:
    """(keys, tempo fields, error) from envelopes (keys, frame, value) with a coarse tempo; one group is one recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        c = pdf[coarse].iloc[0]
        out = measure(pdf[value].to_numpy(float), hop, float("nan") if c is None else float(c))
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **out}])

    return df.select(*keys, "frame", value, coarse).groupBy(*keys).applyInPandas(guarded(run, keys, UNAVAILABLE), schema(df, keys, TEMPO))


def octave_candidates(df: DataFrame, keys: list[str], hop: float, value: str = "flux", coarse: str = "coarse") -> DataFrame:
    """(keys, ratio, bpm, r, live) at half, once and twice the coarse tempo; live where the envelope correlates there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        head, c, rows = {k: pdf[k].iloc[0] for k in keys}, pdf[coarse].iloc[0], []
        if c is not None and math.isfinite(c) and c > 0:
            r = autocorrelation(pdf[value].to_numpy(float))
            for o in OCTAVES:
                f = fit(r, hop, c * o, MULTIPLES[0])
                rows.append({**head, "ratio": o, "bpm": c * o if f["bpm"] is None else f["bpm"], "r": f["r"], "live": f["reason"] != "too_short" and f["r"] >= MIN_R})
        return pd.DataFrame(rows, columns=[*keys, "ratio", "bpm", "r", "live"])

    kinds = dict(df.dtypes)
    return df.select(*keys, "frame", value, coarse).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ratio double, bpm double, r double, live boolean")


def octave_fits(hits: DataFrame, flux: DataFrame, candidates: DataFrame, keys: list[str], beats: int = 4, downbeats: DataFrame | None = None) -> DataFrame:
    """(keys, ratio, bpm, grid, error_steps, error_seconds): the drum grid at each live candidate (keys, ratio, bpm, live).

    Hits (keys, t) and flux (keys, band, frame, flux) are read for each ratio by a join on the keys. ``downbeats`` has
    (keys, ratio, downbeat_seconds), as bars at another tempo begin elsewhere; without them grids hang on the first hit.
    """
    from tessitura.operators import gridfit

    live = candidates.filter("live").select(*keys, "ratio", "bpm")
    by = [*keys, "ratio"]
    null = F.lit(None).cast("double")
    at = live.join(downbeats, by, "left") if downbeats is not None else live.withColumn("downbeat_seconds", null)
    meta = at.select(*by, (F.lit(60.0 * beats) / F.col("bpm")).alias("cycle_seconds"), "downbeat_seconds", null.alias("first_beat_seconds"))
    ratios = live.select(*by)
    g = gridfit.fit(hits.select(*keys, "t").join(ratios, keys), flux.join(ratios, keys), meta, by)
    step = F.col("cycle_seconds") / F.col("steps_per_cycle")
    ok = F.col("grid_status") == "ok"
    g = g.select(*by, ok.alias("grid"), F.when(ok, F.col("error_steps")).alias("error_steps"), F.when(ok, F.col("error_steps") * step).alias("error_seconds"))
    return live.join(g, by)


def arbitrate_octave(fits: DataFrame, keys: list[str], keep_incumbent: bool = False) -> DataFrame:
    """(keys, ratio, bpm, compared, caveat) of the octave to take.

    A neighbour must beat the incumbent on both errors, or the incumbent has no grid; of several the least error in
    steps, then the smaller ratio. ``keep_incumbent`` stays at 1 where both neighbours came in without comparison.
    Keys without the incumbent, or with it alone, keep ratio 1.
    """
    base = fits.filter("ratio = 1").select(*keys, F.col("grid").alias("_g"), F.col("error_steps").alias("_s"), F.col("error_seconds").alias("_e"), F.col("bpm").alias("_bpm"))
    rows = fits.filter("ratio <> 1 and grid").join(base, keys)
    wins = rows.filter(~F.col("_g") | ((F.col("error_steps") < F.col("_s")) & (F.col("error_seconds") < F.col("_e"))))
    best = wins.groupBy(*keys).agg(F.min(F.struct("error_steps", "ratio", "bpm")).alias("_b"), F.count("*").alias("_n"))
    out = base.join(best, keys, "left")
    moved = F.col("_b").isNotNull() & ~((F.lit(keep_incumbent)) & ~F.col("_g") & (F.col("_n") > 1))
    why = F.when(moved & F.col("_g"), F.lit("moved: the drum grid fits better there on both errors")).when(moved, F.lit("moved without comparison: there is no grid at the tempo given"))
    return out.select(*keys, F.when(moved, F.col("_b.ratio")).otherwise(F.lit(1.0)).alias("ratio"), F.when(moved, F.col("_b.bpm")).otherwise(F.col("_bpm")).alias("bpm"), F.col("_g").alias("compared"), why.alias("caveat"))


def grid_confidence(status: Column, label: Column) -> Column:
    """How far the grid can be trusted: the label of a refined tempo, else its status."""
    return F.when(status == "refined", label).otherwise(status)


def bar_period(period: Column, status: Column, has_drums: Column) -> Column:
    """The period to count bars with: a tempo that wasn't refined only serves where there are drums."""
    return F.when((status == "refined") | has_drums, period)


def arbitrate(errors: list[tuple[float, float, float, bool]], keep_incumbent: bool = False) -> float:
    """The octave ratio to take of (ratio, error in steps, error in seconds, has a grid).

    A neighbour must win on both measures, or the incumbent has no grid; of several the least
    error in steps. ``keep_incumbent`` stays at 1 if both neighbours came in without comparison.
    """
    base = next(e for e in errors if e[0] == 1.0)
    wins = [e for e in errors if e[0] != 1.0 and e[3] and (not base[3] or (e[1] < base[1] and e[2] < base[2]))]
    if not wins or (keep_incumbent and not base[3] and len(wins) > 1):
        return 1.0
    return min(wins, key=lambda e: (e[1], e[0]))[0]
