"""Beat phase and bar phase of a track from a low and a bright envelope.

Both are aggregates by key: the phase from the mean rise at each offset of the beat, the bar's first beat
from the balance of low and bright energy on the beats, with the first onset to break ties. What is not settled is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import caveats, confidence_label, num, positive
from tessitura.operators import series

#: Fixed values.
TIE, SLOT_SECONDS, BRIGHT_FLOOR, ONSET_FRACTION, SEARCH_BARS, CONFLICT = 0.25, 0.06, 1e-3, 0.2, 4.0, 0.5


def beat_offsets(flux: DataFrame, periods: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """(keys, offset, contrast): the offset, in frames, whose beats have the greatest mean flux; the earliest of equal ones.

    ``periods`` has (keys, period_seconds). Series no longer than a beat, or without a rise, give offset 0 and contrast 0.
    """
    n = flux.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    p = periods.select(*keys, (positive(F.col("period_seconds")) / num(hop)).alias("_beat")).filter("_beat is not null").join(n, keys)
    p = p.withColumn("_offsets", F.greatest(F.lit(1), F.rint("_beat").cast("int")))
    on = p.filter(F.col("_n") > F.col("_offsets")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_offsets") - 1)))
    last = F.floor((F.col("_n") - 1 - F.col("_o")) / F.col("_beat"))
    on = on.filter(last >= 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    on = on.select(*keys, "_offsets", "_o", F.rint(F.col("_o") + F.col("_k") * F.col("_beat")).cast("long").alias("frame"))
    score = on.join(flux.select(*keys, "frame", "flux"), [*keys, "frame"]).groupBy(*keys, "_offsets", "_o").agg(F.avg("flux").alias("_s"))
    best = score.groupBy(*keys, "_offsets").agg(F.max_by("_o", F.struct("_s", -F.col("_o"))).alias("_o"), F.max("_s").alias("_p"), F.sum("_s").alias("_a")).filter("_p > 0")
    contrast = F.greatest(num(0), num(1) - F.col("_a") / F.col("_offsets") / F.col("_p"))
    found = best.select(*keys, F.col("_o").alias("offset"), contrast.alias("contrast"))
    return p.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("contrast", num(0)).alias("contrast"))


def slot_energy(env: DataFrame, meta: DataFrame, keys: list[str], hop: float, slots: int) -> DataFrame:
    """(keys, slot, low, bright): the median over the bars of the greatest level within 60 ms of each beat.

    ``meta`` has (keys, period_seconds, beat_offset); beats whose window would pass the end are left out.
    """
    width = max(1, round(SLOT_SECONDS / hop))
    ahead = Window.partitionBy(*keys).orderBy("frame").rowsBetween(0, width - 1)
    top = env.select(*keys, "frame", *[F.max(b).over(ahead).alias(b) for b in ("low", "bright")])
    n = env.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    m = meta.join(n, keys)
    beats = ((F.col("_n") * num(hop) - F.col("beat_offset")) / F.col("period_seconds")).cast("long")
    on = m.withColumn("_beats", beats).filter("_beats > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_beats") - 1)))
    on = on.withColumn("frame", F.rint((F.col("beat_offset") + F.col("_k") * F.col("period_seconds")) / num(hop)).cast("long")).filter(F.col("frame") + width <= F.col("_n"))
    got = on.select(*keys, "frame", F.pmod("_k", F.lit(slots)).cast("int").alias("slot")).join(top, [*keys, "frame"])
    return got.groupBy(*keys, "slot").agg(F.percentile("low", num(0.5)).alias("low"), F.percentile("bright", num(0.5)).alias("bright"))


def nearest_slot(onset: Column, offsets: Column, bar: Column) -> Column:
    """The slot at the least distance around the bar, ties to the earlier; null for an onset after four bars."""
    around = F.transform(offsets, lambda c, i: F.struct(F.least(F.pmod(onset - c, bar), F.pmod(c - onset, bar)).alias("d"), i.alias("i")))
    return F.when(onset <= num(SEARCH_BARS) * bar, F.array_min(around)["i"])


def find_downbeat(env: DataFrame, meta: DataFrame, keys: list[str], hop: float, beats: int = 4) -> DataFrame:
    """A row for each key of ``meta`` (keys, period_seconds): offset_seconds, confidences, bar_phase, candidates, status, caveats.

    ``env`` has (keys, frame, low, bright). Status: ok, ambiguous, or unavailable without a period or a rise in the low band.
    """
    flux = series.flux(env, "low", keys)
    facts = flux.groupBy(*keys).agg(F.max("flux").alias("_peak"), F.count("*").alias("_n"), F.sum(F.greatest("low", num(0))).alias("_low"), F.sum(F.greatest("bright", num(0))).alias("_bright"))
    first = series.first_onset(flux, ONSET_FRACTION, keys).select(*keys, (F.col("frame") * num(hop)).alias("_onset"))
    m = meta.select(*keys, positive(F.col("period_seconds")).alias("period_seconds")).join(facts, keys, "left")
    m = m.withColumn("_usable", F.coalesce((F.col("_peak") > 0) & (F.col("_n") >= 4) & F.col("period_seconds").isNotNull(), F.lit(False)))
    live = m.filter("_usable")
    phase = beat_offsets(flux, live.select(*keys, "period_seconds"), keys, hop)
    live = live.join(phase, keys).withColumn("beat_offset", F.col("offset") * num(hop)).join(first, keys, "left")
    level = slot_energy(env, live.select(*keys, "period_seconds", "beat_offset"), keys, hop, beats)
    per_slot = level.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("low", "bright")))).alias("_level"))
    live = live.join(per_slot, keys, "left")

    slots = F.array(*[F.lit(i) for i in range(beats)])
    part = lambda b: F.transform(slots, lambda i: F.coalesce(F.try_element_at(F.col("_level"), i)[b], num(0)))
    total = lambda a: F.aggregate(a, num(0), lambda s, x: s + x)
    live = live.withColumn("_lows", part("low")).withColumn("_brights", part("bright"))
    live = live.withColumn("_tl", total(F.col("_lows"))).withColumn("_tb", total(F.col("_brights")))
    readable = (F.col("_bright") / F.nullif(F.col("_low"), num(0)) >= BRIGHT_FLOOR) & (F.col("_tl") > 0) & (F.col("_tb") > 0)
    live = live.withColumn("_scores", F.when(readable, F.zip_with("_lows", "_brights", lambda x, y: x / F.col("_tl") - y / F.col("_tb"))))
    live = live.withColumn("candidate_offsets", F.transform(slots, lambda i: F.col("beat_offset") + i * F.col("period_seconds")))
    live = live.withColumn("_near", nearest_slot(F.col("_onset"), F.col("candidate_offsets"), F.col("period_seconds") * num(beats)))
    live = live.withColumn("_spread", F.array_max("_scores") - F.array_min("_scores"))
    # from the greatest score down, later slots first among equals
    live = live.withColumn("_order", F.reverse(F.array_sort(F.transform("_scores", lambda x, i: F.struct(x.alias("s"), i.alias("i"))))))
    live = live.withColumn("_top", F.when(F.col("_spread") > 0, F.col("_order")[0]["i"]))
    gap = lambda x: (F.col("_order")[0]["s"] - x["s"]) / F.col("_spread")
    live = live.withColumn("_tied", F.transform(F.filter("_order", lambda x: (x["i"] != F.col("_top")) & (gap(x) <= TIE)), lambda x: x["i"]))

    spectral = F.col("_top").isNotNull()
    tie = spectral & (F.size("_tied") > 0)
    by_onset = tie & F.array_contains("_tied", F.col("_near"))
    against = spectral & ~tie & F.col("_near").isNotNull() & (F.col("_near") != F.col("_top"))
    by_onset, against = F.coalesce(by_onset, F.lit(False)), F.coalesce(against, F.lit(False))
    slot = F.when(by_onset | ~spectral, F.coalesce("_near", F.lit(0))).otherwise(F.col("_top"))
    margin = F.least(num(1), gap(F.col("_order")[1]) / num(TIE)) if beats > 1 else num(1)
    sure = F.when(~spectral, num(1.0 if beats == 1 else 0.0)).when(against, F.least(margin, num(CONFLICT))).otherwise(margin)
    live = live.withColumn("bar_phase", slot).withColumn("phase_confidence", sure)
    offset_of = lambda i: F.get(F.col("candidate_offsets"), i)
    others = F.when(~spectral, F.transform(F.filter(slots, lambda i: i != F.col("bar_phase")), offset_of)).when(
        tie, F.transform(F.filter(F.concat(F.array("_top"), "_tied"), lambda i: i != F.col("bar_phase")), offset_of)
    ).when(against, F.array(offset_of(F.col("_near"))))
    confidence = F.when(spectral | F.lit(beats == 1), F.least("contrast", "phase_confidence")).otherwise(num(0))
    notes = caveats(
        (~spectral & F.lit(beats > 1), F.lit("nothing in the bright band tells the beats of a bar apart, so all remain candidates")),
        (tie, F.format_string("%d other beats score within a quarter of the winner", F.size("_tied"))),
        (by_onset, F.lit("the tie was broken by convention: the first onset is taken to lie on a downbeat")),
        (against, F.lit("the balance of the bands and the first onset disagree about the first beat")),
    )
    live = live.select(
        *keys,
        offset_of(F.col("bar_phase")).alias("offset_seconds"),
        confidence.alias("confidence"),
        "beat_offset",
        F.col("contrast").alias("beat_confidence"),
        "phase_confidence",
        "bar_phase",
        "candidate_offsets",
        F.coalesce("_scores", F.transform(slots, lambda i: num(0))).alias("candidate_scores"),
        F.coalesce(others, F.array().cast("array<double>")).alias("unresolved_offsets"),
        F.when(by_onset, "onset").when(spectral | F.lit(beats == 1), "spectral").when(F.col("_near").isNotNull(), "onset").otherwise("none").alias("resolved_by"),
        F.when(F.col("phase_confidence") >= 1, "ok").otherwise("ambiguous").alias("status"),
        notes.alias("caveats"),
    )
    out = m.select(*keys, "_usable").join(live, keys, "left")
    out = out.withColumn("status", F.coalesce("status", F.lit("unavailable"))).withColumn("confidence_label", confidence_label(F.coalesce("confidence", num(0))))
    return out.withColumn("caveats", F.coalesce("caveats", F.array(F.lit("no beat period, or nothing in the low band to lock to")))).drop("_usable")
