"""Bass notes from an F0 track: smoothing, segments, short-segment merge, onset backdating, steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import caveats, note_name, num, positive
from tessitura.operators.degrade import guarded, schema

#: Fixed values.
MEDIAN, OCTAVE_MEDIAN, MIN_SECONDS, MERGE_SEMITONES, MIN_VOICED = 5, 21, 0.06, 1, 0.15
BACKDATE_SEMITONES, BACKDATE_SECONDS = 1.0, 0.06
MANY_MOVED, HIGH_NOTE, LITTLE_VOICED, DETUNED = 0.05, 48, 0.3, 25.0


def _medians(x: np.ndarray, half: int, at: np.ndarray) -> np.ndarray:
    """Medians of the windows around the places ``at``, without NaN and what lies beyond the ends."""
    places = at[:, None] + np.arange(-half, half + 1)
    w = np.where((places >= 0) & (places < len(x)), x[np.clip(places, 0, len(x) - 1)], np.nan)
    w.sort(axis=1)  # NaN last
    k = np.maximum(1, (~np.isnan(w)).sum(1))
    rows = np.arange(len(at))
    return (w[rows, (k - 1) // 2] + w[rows, k // 2]) / 2


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """Skips NaN; stays NaN where ``x`` is.

    A whole window in which the value changes once at most has more of its middle value than of the other, so that one is its median;
    only the other windows are sorted.
    """
    half, n = width // 2, len(x)
    if n > width:
        change = np.cumsum(np.r_[0, x[1:] != x[:-1]])  # NaN differs from itself
        hard = np.ones(n, bool)
        hard[half : n - half] = change[2 * half :] - change[: n - 2 * half] > 1
        out, at = x.astype(float), np.flatnonzero(hard)
        for i in range(0, len(at), 1 << 16):
            out[at[i : i + (1 << 16)]] = _medians(x, half, at[i : i + (1 << 16)])
        return np.where(np.isnan(x), np.nan, out)
    padded = np.r_[np.full(half, np.nan), x, np.full(half, np.nan)]
    with np.errstate(all="ignore"):
        import warnings

        warnings.simplefilter("ignore", RuntimeWarning)
        out = np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1) if n else x
    return np.where(np.isnan(x), np.nan, out)


def merge_short(segments: list[list[int]], least: float) -> list[list[int]]:
    """Segments [start, end, midi]: the shortest below ``least`` frames joins its longer adjoining
    neighbour within a semitone, or goes; again until none is short."""
    segments = [list(s) for s in segments]
    size = lambda s: s[1] - s[0]
    while short := [i for i, s in enumerate(segments) if size(s) < least]:
        i = min(short, key=lambda j: (size(segments[j]), j))
        s = segments.pop(i)
        beside = [n for j in (i - 1, i) if 0 <= j < len(segments) for n in [segments[j]] if (n[1] == s[0] or n[0] == s[1]) and abs(n[2] - s[2]) <= MERGE_SEMITONES]
        if beside:
            best = max(beside, key=size)  # of equal ones the first
            best[0], best[1] = min(best[0], s[0]), max(best[1], s[1])
    return segments


def segment(f0: np.ndarray, voiced: np.ndarray, probability: np.ndarray, hop: float) -> tuple[str, list[tuple]]:
    """(status, [(start, end, midi, cents)]): frames and MIDI numbers of the notes."""
    usable = voiced & np.isfinite(f0) & (f0 > 0)
    if not len(f0) or usable.mean() < MIN_VOICED:
        return "unvoiced", []
    with np.errstate(all="ignore"):
        raw = np.where(np.isfinite(f0) & (f0 > 0), 69 + 12 * np.log2(np.where(f0 > 0, f0, 1) / 440), np.nan)
    midi = running_median(np.where(usable, raw, np.nan), MEDIAN)
    centre = running_median(midi, OCTAVE_MEDIAN)
    moved = midi + 12 * np.rint((centre - midi) / 12)
    midi = np.where(np.abs(moved - centre) < np.abs(midi - centre), moved, midi)
    rounded = np.rint(midi)
    pitched = np.flatnonzero(np.isfinite(rounded))
    new = np.r_[True, (np.diff(pitched) != 1) | (np.diff(rounded[pitched]) != 0)][: len(pitched)]
    first = pitched[new]
    last = pitched[np.r_[new[1:], True][: len(pitched)]]
    segments = [list(s) for s in zip(first.tolist(), (last + 1).tolist(), rounded[first].astype(int).tolist(), strict=True)]
    segments = merge_short(segments, MIN_SECONDS / hop)
    floor, most = 0, int(BACKDATE_SECONDS / hop)
    out = []
    for start, end, note in segments:
        at = start
        while start - at < most and at - 1 >= floor and not usable[at - 1] and np.isfinite(raw[at - 1]) and abs(raw[at - 1] - note) <= BACKDATE_SEMITONES and not probability[at - 1] > probability[at]:
            at -= 1
        inside = np.sort(f0[start:end][usable[start:end]])
        n = len(inside)
        hz = float((inside[(n - 1) // 2] + inside[n // 2]) / 2) if n else float("nan")
        out.append((at, end, note, 100 * (69 + 12 * np.log2(hz / 440) - note)))
        floor = end
    return ("ok" if out else "unvoiced"), out


def figures(f0: np.ndarray, voiced: np.ndarray) -> tuple[float, float]:
    """The share of frames that are voiced, and of these the share that the octave guard moves."""
    usable = voiced & np.isfinite(f0) & (f0 > 0)
    if not usable.any():
        return 0.0, 0.0
    midi = running_median(np.where(usable, 69 + 12 * np.log2(np.where(usable, f0, 440) / 440), np.nan), MEDIAN)
    centre = running_median(midi, OCTAVE_MEDIAN)
    steps = np.rint((centre - midi) / 12)
    with np.errstate(invalid="ignore"):
        moved = (steps != 0) & (np.abs(midi + 12 * steps - centre) < np.abs(midi - centre))
    return float(usable.mean()), float(moved.sum() / usable.sum())


NOTES = "status string, note int, start_frame long, end_frame long, midi int, cents double, voiced_share double, octave_share double"


def segment_notes(df: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """(keys, NOTES, error) from (keys, frame, f0_hz, voiced, voiced_prob); a track without notes gives one row with its status.

    A row with ``length`` stands for so many frames from its own on, which only its task lays out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if "length" in pdf.columns:
            n = pdf["length"].to_numpy()
            pdf = pdf.iloc[np.repeat(np.arange(len(pdf)), n)]
            pdf = pdf.assign(frame=pdf["frame"].to_numpy() + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        pdf = pdf.sort_values("frame")
        f0, voiced = pdf["f0_hz"].to_numpy(float), pdf["voiced"].fillna(True).to_numpy(bool)
        status, notes = segment(f0, voiced, pdf["voiced_prob"].to_numpy(float), hop)
        share, moved = figures(f0, voiced)
        head = {**{k: pdf[k].iloc[0] for k in keys}, "voiced_share": share, "octave_share": moved}
        if notes:
            a, b, m, c = (list(x) for x in zip(*notes, strict=True))
            return pd.DataFrame({**{k: [v] * len(notes) for k, v in head.items()}, "status": status, "note": range(len(notes)), "start_frame": a, "end_frame": b, "midi": m, "cents": c})
        return pd.DataFrame([{**head, "status": status, "note": None, "start_frame": None, "end_frame": None, "midi": None, "cents": None}])

    failed = {"status": "failed", "note": None, "start_frame": None, "end_frame": None, "midi": None, "cents": None, "voiced_share": None, "octave_share": None}
    return df.groupBy(*keys).applyInPandas(guarded(run, keys, failed), schema(df, keys, NOTES))


def resolved(grid: DataFrame, keys: list[str], beats: int = 4, steps: int = 16) -> DataFrame:
    """(keys, anchor, step_seconds, steps_per_cycle) from (keys, anchor_seconds, step_seconds, steps_per_cycle, beat_period_seconds, downbeat_seconds).

    A length of step that is given wins; else the beat's period is cut, and the downbeat, if known, is the anchor.
    """
    given = F.col("step_seconds").isNotNull()
    n = F.when(given, F.col("steps_per_cycle")).otherwise(F.coalesce("steps_per_cycle", F.lit(steps)))
    cut = F.when(n > 0, positive(F.col("beat_period_seconds")) * num(beats) / n)
    anchor = F.when(given, F.col("anchor_seconds")).otherwise(F.coalesce("downbeat_seconds", "anchor_seconds"))
    length = positive(F.when(given, F.col("step_seconds")).otherwise(cut))
    return grid.select(*keys, F.coalesce(anchor, num(0)).alias("anchor"), length.alias("step_seconds"), F.when(n > 0, n).alias("steps_per_cycle"))


def on_grid(notes: DataFrame, grid: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """Notes (keys, start_frame, ...) with ``step``: the nearest, folded into the cycle where its length is known; null without a grid."""
    n = notes.join(resolved(grid, keys), keys, "left")
    k = F.rint((F.col("start_frame") * num(hop) - F.col("anchor")) / F.col("step_seconds")).cast("long")
    step = F.when(F.col("steps_per_cycle").isNull(), k).otherwise(F.pmod(k, F.col("steps_per_cycle").cast("long")))
    return n.withColumn("step", step).drop("anchor", "step_seconds", "steps_per_cycle")


def bass_line(f0: DataFrame, grid: DataFrame, wanted: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """(keys, bass_line) for each of ``wanted`` (keys, silent): status, notes on the grid and what to know about them.

    A silent one isn't looked at. ``grid`` as for ``resolved``. Notes are in their order in the recording.
    """
    live = f0.join(wanted.filter(~F.col("silent")).select(*keys), keys, "left_semi")
    pitchless = live.withColumn("error", F.lit(None).cast("string")) if "error" not in live.columns else live
    pitchless = pitchless.filter("error is not null").groupBy(*keys).agg(F.min("error").alias("pitch_error"))
    live = live.filter("frame is not null").join(pitchless.select(*keys), keys, "left_anti")
    notes = on_grid(segment_notes(live.select(*keys, "frame", "f0_hz", "voiced", "voiced_prob"), keys, hop), grid, keys, hop)
    note = F.struct("note", note_name(F.col("midi")).alias("name"), "midi", (F.col("start_frame") * num(hop)).alias("start_seconds"), ((F.col("end_frame") - F.col("start_frame")) * num(hop)).alias("seconds"), "cents", "step")
    some = F.col("note").isNotNull()
    line = notes.groupBy(*keys).agg(
        F.first("status").alias("status"),
        F.array_sort(F.collect_list(F.when(some, note))).alias("notes"),
        F.percentile("midi", num(0.5)).alias("median_midi"),
        F.percentile("cents", num(0.5)).alias("median_cents"),
        F.first("voiced_share").alias("voiced_share"),
        F.first("octave_share").alias("octave_share"),
        F.count("step").alias("_placed"),
        F.first("error").alias("error"),
    )
    out = wanted.join(line, keys, "left").join(pitchless, keys, "left").withColumn("error", F.coalesce("pitch_error", "error"))
    status = F.when(F.col("silent"), "silent").otherwise(F.coalesce("status", F.lit("failed")))
    ok = F.coalesce(status == "ok", F.lit(False))
    said = caveats(
        (F.col("silent"), F.lit("below the silence floor, so no pitch was looked for")),
        (~F.col("silent") & F.col("error").isNotNull(), F.concat(F.lit("the bass could not be followed: "), F.col("error"))),
        (~F.col("silent") & F.col("status").isNull() & F.col("error").isNull(), F.lit("there is no pitch track of this source")),
        (ok & (F.col("octave_share") > MANY_MOVED), F.format_string("the octave guard moved %.1f%% of the voiced frames; the fundamental is weak and the octave uncertain", F.col("octave_share") * 100)),
        (ok & (F.col("median_midi") > HIGH_NOTE), F.format_string("the median note is %s, high for a bass: it may be an octave off throughout", note_name(F.col("median_midi")))),
        (ok & (F.col("voiced_share") < LITTLE_VOICED), F.format_string("notes rest on %.0f%% of the frames; short or quiet ones may be missing", F.col("voiced_share") * 100)),
        (ok & (F.abs("median_cents") > DETUNED), F.format_string("the line lies %+.0f cents off equal temperament, which is a tuning and not wrong notes", F.col("median_cents"))),
        (ok & (F.col("_placed") == 0), F.lit("there is no grid, so notes have no steps")),
    )
    none = F.array().cast(out.schema["notes"].dataType)
    doc = F.struct(status.alias("status"), F.coalesce("notes", none).alias("notes"), "median_midi", "median_cents", "voiced_share", said.alias("caveats"))
    return out.select(*keys, doc.alias("bass_line"))
