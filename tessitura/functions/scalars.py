"""Scalar column functions: null means "could not be computed" and is never taken for zero.

Rounding is half to even throughout (``rint``), modulo is never negative (``pmod``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SAMPLE_RATE, HOP, N_FFT = 44100, 512, 2048
HOP_SECONDS = HOP / SAMPLE_RATE
NOTE_NAMES = ["c", "c#", "d", "d#", "e", "f", "f#", "g", "g#", "a", "a#", "b"]


def num(x: float) -> Column:
    return F.lit(float(x))


def r6(x: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.bround(x, 6) + num(0)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clean(x: Column) -> Column:
    """Null, NaN and infinity become 0."""
    return F.when(finite(x), x).otherwise(num(0))


def positive(x: Column) -> Column:
    return F.when(finite(x) & (x > 0), x)


def ramp(value: Column, threshold: float, saturation: float) -> Column:
    """Null short of the threshold, then linear to 1 at the saturation; the two give the direction."""
    if threshold == saturation:
        raise ValueError("a ramp needs two different ends")
    at = (value - num(threshold)) / num(saturation - threshold)
    return F.when(finite(value) & (at >= 0), F.least(num(1), at))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The element of a sorted array at the nearest rank, half to even; null if there is none."""
    last = F.size(values) - 1
    return F.get(values, F.least(last, F.greatest(F.lit(0), F.rint(num(fraction) * last).cast("int"))))


def every(*parts: Column) -> Column:
    """The least of the parts, null if any is null."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.least(*parts) if len(parts) > 1 else parts[0])


def between(value: Column, low: float, high: float, margin: float) -> Column:
    """A ramp from either side of [low, high]; 1 from ``margin`` inside on."""
    return every(ramp(value, low, low + margin), ramp(value, high, high - margin))


def evidence(**parts: Column) -> Column:
    """A map of the parts that aren't null."""
    pairs = [x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def chroma_entropy(chroma: Column) -> Column:
    """Shannon entropy of 12 pitch classes over ln 12; negatives count as 0."""
    up = F.transform(chroma, lambda x: F.greatest(x, num(0)))
    total = F.aggregate(up, num(0), lambda a, x: a + x)
    terms = F.aggregate(up, num(0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(num(0)))
    good = (F.size(chroma) == 12) & F.forall(chroma, finite) & (total > 0)
    return F.when(good, F.least(num(1), F.greatest(num(0), terms / num(math.log(12)))))


def midi_from_hz(hz: Column) -> Column:
    return F.when(hz > 0, num(69) + num(12) * F.log2(hz / num(440)))


def hz_from_midi(midi: Column) -> Column:
    return num(440) * F.pow(num(2), (midi - num(69)) / num(12))


def note_name(midi: Column) -> Column:
    """Lower case with sharps; MIDI 60 is c4."""
    m = F.rint(midi).cast("int")
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat(F.element_at(names, F.pmod(m, F.lit(12)) + 1), (F.floor(m / 12) - 1).cast("int").cast("string"))


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit("track"))


def seconds_to_frames(seconds: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(seconds * num(SAMPLE_RATE) / num(HOP)).cast("int"))


def classify_density(per_second: Column, sparse: float = 1.0, busy: float = 5.0) -> Column:
    return F.when(finite(per_second) & (per_second >= 0), F.when(per_second < sparse, "sparse").when(per_second < busy, "moderate").otherwise("busy"))


def suggest_cycle_seconds(bpm: Column, beats: int = 4) -> Column:
    return F.bround(num(beats * 60) / positive(bpm), 6)


def match_grid(value: Column, table: dict[str, float], tolerance: float = 0.15) -> Column:
    """The label with the least relative error, null beyond the tolerance."""
    rows = F.array(*[F.struct((F.abs(value - num(v)) / num(v)).alias("e"), F.lit(k).alias("k")) for k, v in table.items()])
    best = F.array_min(rows)
    return F.when(value.isNotNull() & (best["e"] <= tolerance), best["k"])


def confidence_label(r: Column, high: float = 0.5, medium: float = 0.25) -> Column:
    return F.when(r >= high, "high").when(r >= medium, "medium").otherwise("low")


def within_bpm_tolerance(candidate: Column, coarse: Column, tolerance: float = 0.03) -> Column:
    good = finite(candidate) & finite(coarse) & (candidate > 0) & (coarse > 0)
    return F.coalesce(good & (F.abs(candidate - coarse) / coarse <= tolerance), F.lit(False))


def grid_step(start: Column, anchor: Column, step: Column, n: int) -> Column:
    return F.pmod(F.rint((start - anchor) / step).cast("long"), F.lit(n).cast("long"))


def fractional_steps(t: Column, cycle: Column, anchor: Column, steps: int) -> Column:
    """Signed distance to the nearest step, within half a step."""
    x = (t - anchor) / cycle * num(steps)
    return x - F.rint(x)


def resolve_grid(step: Column, beat: Column, steps_per_beat: int = 4) -> Column:
    """The length of a step: given, or from the beat."""
    return F.coalesce(positive(step), positive(beat) / num(steps_per_beat))


def cycle_seconds(period: Column, bpm: Column, beats: int = 4) -> Column:
    return F.coalesce(positive(period) * num(beats), num(60 * beats) / positive(bpm))


def air_over_noise(air: Column, noise: Column) -> Column:
    return air / F.nullif(air + noise, num(0))


def score(value: Column, threshold: float, saturation: float) -> Column:
    return F.coalesce(ramp(value, threshold, saturation), num(0))


def rotate_to_c(pitch_classes: Column) -> Column:
    """From an a-rooted to a c-rooted order of 12."""
    return F.concat(F.slice(pitch_classes, 4, 9), F.slice(pitch_classes, 1, 3))


def tonal_centre(key: Column, scale: Column) -> Column:
    return F.when(key.isNotNull(), F.concat_ws(" ", key, scale))


def is_silent(rms: Column, floor: float = 1e-3) -> Column:
    """A level that wasn't measured isn't silence."""
    return F.coalesce(rms < floor, F.lit(False))


def unavailable(fields: dict[str, Column]) -> Column:
    """Sorted dotted paths of the fields that are null."""
    paths = F.array(*[F.when(c.isNull(), F.lit(p)) for p, c in sorted(fields.items())])
    return F.filter(paths, lambda x: x.isNotNull())


def caveats(*pairs: tuple[Column, Column]) -> Column:
    """The messages whose condition holds."""
    return F.filter(F.array(*[F.when(c, m) for c, m in pairs]), lambda x: x.isNotNull())


def capped(items: Column, most: int) -> Column:
    """(items, truncated_from): at most so many, and how many there were if that's more."""
    return F.struct(F.slice(items, 1, most).alias("items"), F.when(F.size(items) > most, F.size(items)).alias("truncated_from"))
