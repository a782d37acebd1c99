"""The hints document: subdivision feel, density, cycle, tonal centre, section lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import capped, classify_density, match_grid, note_name, num, positive, suggest_cycle_seconds

from tessitura.operators import series, vocab

#: Fixed values.
MIN_INTERVALS, STRAIGHT_TOLERANCE, STRAIGHT_MIN, BASE_MIN, LILT = 16, 0.22, 0.80, 0.50, 1.1
SWING_RATIO, CLUSTER_MAD, CLUSTER_MIN, ALTERNATION_MIN, SPLIT = (1.5, 2.5), 0.12, 0.35, 0.75, 0.10
STRAIGHT_UNITS = {"straight 8ths": 0.5, "straight 16ths": 0.25, "straight 32nds": 0.125}
SWUNG_PAIRS = {"swung 8ths": 1.0, "swung 16ths": 0.5}
NOTE_CAP, SECTION_CAP = 32, 24


def feel_evidence(iois: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Per key what both hypotheses need from the intervals (``ioi`` at ``t``)."""
    w = Window.partitionBy(*keys)
    # the split lies between the intervals at two nearest ranks
    d = iois.withColumn("unit", F.percentile("ioi", num(0.5)).over(w)).withColumn("_last", F.count("*").over(w) - 1).withColumn("_rank", F.row_number().over(w.orderBy("ioi")) - 1)
    at = lambda share: F.max(F.when(F.col("_rank") == F.rint(num(share) * F.col("_last")), F.col("ioi"))).over(w)
    d = d.withColumn("split", (at(SPLIT) + at(1 - SPLIT)) / num(2)).drop("_last", "_rank")
    d = d.withColumn("long", F.col("ioi") >= F.col("split")).withColumn("k", F.least(num(4), F.greatest(num(1), F.rint(F.col("ioi") / F.col("unit")))))
    d = d.withColumn("cross", (F.col("long") != F.lag("long").over(w.orderBy(t))).cast("int"))
    for name, side in (("long", F.col("long")), ("short", ~F.col("long"))):
        d = d.withColumn(f"med_{name}", F.percentile(F.when(side, F.col("ioi")), num(0.5)).over(w))
    dev = F.abs(F.col("ioi") - F.when(F.col("long"), F.col("med_long")).otherwise(F.col("med_short")))
    share = F.avg(F.col("long").cast("double"))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.first("unit").alias("unit"),
        F.avg((F.abs(F.col("ioi") - F.col("k") * F.col("unit")) <= num(STRAIGHT_TOLERANCE) * F.col("unit")).cast("double")).alias("on_grid"),
        F.avg((F.col("k") == 1).cast("double")).alias("base"),
        F.least(share, num(1) - share).alias("cluster"),
        (F.sum("cross") / F.nullif((F.count("*") - 1).cast("double"), num(0))).alias("alternation"),
        F.avg(F.when(F.col("long"), F.col("ioi"))).alias("long_mean"),
        F.avg(F.when(~F.col("long"), F.col("ioi"))).alias("short_mean"),
        (F.percentile(F.when(F.col("long"), dev), num(0.5)) / F.first("med_long")).alias("long_mad"),
        (F.percentile(F.when(~F.col("long"), dev), num(0.5)) / F.first("med_short")).alias("short_mad"),
    )


def feel(evidence: DataFrame, beat: Column) -> Column:
    """The subdivision's name where exactly one hypothesis holds, else null."""
    e = F.col
    paired = (e("cluster") >= CLUSTER_MIN) & (e("alternation") >= ALTERNATION_MIN)
    ratio = e("long_mean") / e("short_mean")
    straight = (e("on_grid") >= STRAIGHT_MIN) & (e("base") >= BASE_MIN) & ~F.coalesce(paired & (ratio > LILT), F.lit(False))
    swung = paired & (e("long_mad") <= CLUSTER_MAD) & (e("short_mad") <= CLUSTER_MAD) & ratio.between(*SWING_RATIO)
    a = F.when(straight, match_grid(e("unit") / beat, STRAIGHT_UNITS))
    b = F.when(swung, match_grid((e("long_mean") + e("short_mean")) / beat, SWUNG_PAIRS))
    return F.when(e("n") >= MIN_INTERVALS, F.when(a.isNull(), b).when(b.isNull(), a))


def feel_hint(evidence: DataFrame, beat: Column) -> Column:
    """struct(value, note): the subdivision's name, or why there is none."""
    value = feel(evidence, beat)
    note = (
        F.when(value.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("n") < MIN_INTERVALS, F.format_string("%d intervals between onsets, %d are needed to tell how the beat is cut", F.col("n"), F.lit(MIN_INTERVALS)))
        .when(positive(beat).isNull(), "no tempo to read the intervals against")
        .otherwise(F.format_string("no one reading holds: %.2f of the intervals lie on multiples of the middle one, %.2f alternate between long and short", F.col("on_grid"), F.coalesce(F.col("alternation"), num(0))))
    )
    return F.struct(value.alias("value"), note.alias("note"))


def section_line(start: Column, bars: Column, label: Column, active: Column) -> Column:
    playing = F.when(F.size(active) > 0, F.array_join(active, ", ")).otherwise(F.lit("nothing playing"))
    return F.concat(F.format_string("bar %s x%s ", start.cast("string"), bars.cast("string")), F.coalesce(label, F.lit("unlabelled")), F.lit(": "), playing)


def choose_bpm(*chain: Column) -> Column:
    """The first usable tempo of a fallback chain."""
    return F.coalesce(*[positive(c) for c in chain])


def grid_bpm(refined: Column, drums: Column, mix: Column) -> Column:
    """The tempo that subdivisions are read against: the drums come before the mix."""
    return choose_bpm(refined, drums, mix)


def reported_bpm(refined: Column, mix: Column, drums: Column) -> Column:
    """struct(value, note): the tempo shown: the mix comes before the drums."""
    note = (
        F.when(positive(refined).isNotNull(), F.lit(None).cast("string"))
        .when(positive(mix).isNotNull(), "the tempo is the mix's own estimate, not refined")
        .when(positive(drums).isNotNull(), "the tempo is the drums' estimate; the mix has none")
        .otherwise("tempo unknown, so no cycle length is suggested")
    )
    return F.struct(choose_bpm(refined, mix, drums).alias("value"), note.alias("note"))


def density_hint(density: Column, present: Column, silent: Column, name: str) -> Column:
    """struct(value, note): sparse, moderate or busy, or why not."""
    said = F.when(present & ~silent, classify_density(density))
    note = F.when(~present, F.lit(f"no {name} source, density not reported")).when(silent, F.lit(f"the {name} are below the silence floor, density not reported")).when(said.isNull(), F.lit(f"{name} onset density unavailable"))
    return F.struct(said.alias("value"), note.alias("note"))


#: The least key confidence that names a tonal centre; each estimator has its own scale.
CENTRE_MIN = {"profile_correlation": 0.05, "profile_lead": 0.5}


def centre_hint(mix: dict[str, Column], bass: dict[str, Column], estimator: str = "profile_lead") -> Column:
    """struct(value, note) of the tonal centre: the mix's, else a bass that sounds; each has key, scale, confidence, present, silent."""

    def named(x):
        sure = x["present"] & ~x["silent"] & (x["confidence"] >= CENTRE_MIN[estimator])
        return F.when(F.coalesce(sure, F.lit(False)) & x["key"].isNotNull(), F.concat_ws(" ", x["key"], x["scale"]))

    own, low = named(mix), named(bass)
    note = (
        F.when(own.isNotNull(), F.lit(None).cast("string"))
        .when(bass["present"] & bass["silent"], "the bass is below the silence floor and no fallback for the tonal centre")
        .when(low.isNotNull(), "the tonal centre is the bass's; the mix's key is uncertain")
        .otherwise("key uncertain, no tonal centre reported")
    )
    return F.struct(F.coalesce(own, low).alias("value"), note.alias("note"))


def drum_grid_hint(summary: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drum_grid, note) from the summaries and patterns of the drum operator."""
    steps = patterns.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cls", "steps"))).alias("_s"))
    of = lambda c: F.coalesce(F.try_element_at("_s", F.lit(c)), F.array().cast("array<long>")).alias(f"{c}_steps")
    out = summary.join(steps, keys, "left")
    hint = F.struct("status", "steps_per_cycle", of("kick"), of("snare"), of("hat"), F.col("unclassified").alias("unclassified_count"), "caveats")
    note = F.when(F.col("status") != "ok", F.format_string("the drum grid's status is %s", F.col("status")))
    return out.select(*keys, hint.alias("drum_grid"), note.alias("note"))


def bass_line_hint(notes: DataFrame, keys: list[str], cap: int = NOTE_CAP) -> DataFrame:
    """(keys, bass_line, note) from notes (keys, status, note, midi, step); a row without a note carries the status alone.

    Names in order, at most ``cap`` of them; the share of the notes on each step, rounded half to even.
    """
    some = F.col("midi").isNotNull()
    line = notes.groupBy(*keys).agg(
        F.first("status").alias("status"),
        F.array_sort(F.collect_list(F.when(some, F.struct("note", note_name(F.col("midi")).alias("name"))))).alias("_n"),
        F.percentile(F.when(some, F.col("midi")), num(0.5)).alias("median_midi_note"),
        F.count("step").alias("_placed"),
    )
    share = notes.filter("step is not null").groupBy(*keys, "step").agg(F.count("*").alias("_k"))
    share = share.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "_k"))).alias("_p"))
    out = line.join(share, keys, "left")
    shown = capped(F.transform("_n", lambda x: x["name"]), cap)
    steps = F.coalesce(F.transform("_p", lambda x: x["step"].cast("long")), F.array().cast("array<long>"))
    shares = F.coalesce(F.transform("_p", lambda x: F.bround(x["_k"] / F.col("_placed"), 4)), F.array().cast("array<double>"))
    hint = F.struct("status", shown["items"].alias("note_sequence"), shown["truncated_from"].alias("truncated_from"), "median_midi_note", steps.alias("steps"), shares.alias("step_share"))
    return out.select(*keys, hint.alias("bass_line"), F.when(F.col("status") != "ok", F.format_string("the bass line's status is %s", F.col("status"))).alias("note"))


def arrangement_hint(sections: DataFrame, keys: list[str], absent: DataFrame | None = None, cap: int = SECTION_CAP) -> DataFrame:
    """(keys, arrangement, note) from sections (keys, start_bar, length_bars, active, label); ``absent`` has (keys, source)."""
    line = section_line(F.col("start_bar"), F.col("length_bars"), F.col("label"), F.filter(F.split("active", ","), lambda x: x != ""))
    s = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_bar", line.alias("line")))).alias("_l"), F.sum("length_bars").alias("bar_count"))
    gone = absent.groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("_a")) if absent is not None else s.select(*keys, F.array().cast("array<string>").alias("_a"))
    s = s.join(gone, keys, "left").withColumn("_a", F.coalesce("_a", F.array().cast("array<string>")))
    shown = capped(F.transform("_l", lambda x: x["line"]), cap)
    hint = F.struct(F.lit("ok").alias("status"), "bar_count", shown["items"].alias("sections"), shown["truncated_from"].alias("truncated_from"), F.col("_a").alias("absent_tracks"))
    note = F.when(F.size("_a") > 0, F.concat(F.lit("not in this recording at all: "), F.array_join("_a", ", ")))
    return s.select(*keys, hint.alias("arrangement"), note.alias("note"))


def tempo_note(status: Column, label: Column, r: Column) -> Column:
    """What to know about the tempo, null where it is refined and sure."""
    return (
        F.when((status == "refined") & (label != "low"), F.lit(None).cast("string"))
        .when(status == "unavailable", "the tempo could not be refined; it is the estimate as it came")
        .when(status == "coarse", "the tempo was not refined: no multiple of the beat correlates, so the grid is not exact to the bar")
        .otherwise(F.format_string("the tempo is refined but weak (%.3f); take the cycle length as approximate", r))
    )


def octave_note(octave: Column, ratio: Column, compared: Column, others: Column) -> Column:
    """What to know about the octave. ``ratio`` is the arbitrated one, null without a grid to arbitrate with; ``others`` are the live tempos besides."""
    rest = F.when(F.size(others) > 0, F.concat(F.lit("; also live: "), F.array_join(F.transform(others, lambda x: F.format_string("%.2f", x)), ", "))).otherwise(F.lit(""))
    return (
        F.when(ratio != 1, F.concat(F.format_string("the octave was moved by x%.1f ", ratio), F.when(compared, "because the drum grid fits better there on both errors").otherwise("without comparison, as there is no grid at the tempo given")))
        .when(octave != "ambiguous", F.lit(None).cast("string"))
        .when(ratio.isNotNull(), F.concat(F.lit("correlation did not settle the octave; the drum grid kept it"), rest))
        .otherwise(F.concat(F.lit("the octave is not settled, and there is no drum grid to settle it"), rest))
    )


def stripped_note(sources: Column) -> Column:
    """Names the sources (source, status, events) that say ok but hold no events, as in a summary without its lists."""
    bare = F.array_sort(F.transform(F.filter(sources, lambda x: (x["status"] == "ok") & (x["events"] == 0)), lambda x: x["source"]))
    return F.when(F.size(bare) > 0, F.concat(F.lit("event lists are missing though the status is ok: "), F.array_join(bare, ", ")))


def notes(*parts: Column) -> Column:
    """The notes that were given, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*parts)))


def build(df: DataFrame) -> DataFrame:
    """The hints of each track from its summary: refined, drums_bpm, mix_bpm, onset_density, key, scale, key_confidence, bass_silent.

    Adds bpm, suggested_cycle_seconds, drum_density, tonal_centre and ``notes``.
    """
    quiet, yes = F.coalesce("bass_silent", F.lit(False)), F.lit(True)
    bpm = reported_bpm(F.col("refined"), F.col("mix_bpm"), F.col("drums_bpm"))
    density = density_hint(F.col("onset_density"), yes, F.lit(False), "drums")
    bass = {"key": F.col("key"), "scale": F.col("scale"), "confidence": F.col("key_confidence"), "present": yes, "silent": quiet}
    centre = centre_hint({**bass, "present": F.lit(False), "silent": F.lit(False)}, bass)
    return df.select("*", bpm["value"].alias("bpm"), suggest_cycle_seconds(bpm["value"]).alias("suggested_cycle_seconds"), density["value"].alias("drum_density"), centre["value"].alias("tonal_centre"), notes(bpm["note"], density["note"], centre["note"]).alias("notes"))


def assemble(tracks: DataFrame, sources: DataFrame) -> DataFrame:
    """(track, hints): what a track's documents suggest, each part null where it can't be told, with notes that say why.

    ``tracks`` and ``sources`` are the nested rows of ``operators.track``. A track without sources has hints that are null and notes.
    """
    keys = ["track"]
    of = lambda s, c: F.any_value(F.when(F.col("source") == s, c), ignoreNulls=True)
    there = sources.filter("status = 'ok'")
    parts = []
    for s in ("mix", "drums", "bass"):
        parts += [of(s, F.lit(True)).alias(f"{s}_there"), of(s, F.col("silent")).alias(f"{s}_silent"), of(s, F.col("rhythm.bpm")).alias(f"{s}_bpm"), of(s, F.col("rhythm.onset_density")).alias(f"{s}_density")]
        parts += [of(s, F.col(f"tonal.{c}")).alias(f"{s}_{c}") for c in ("key", "scale", "key_confidence")]
    bass = there.filter("source = 'bass'").select("track", F.col("spectral.band_low").alias("low"), F.col("spectral.brightness").alias("brightness"), F.col("spectral.centroid_energy_hz").alias("centroid"), "silent", F.coalesce("bass_line.status", F.lit("not_attempted")).alias("status"))
    drums = there.filter("source = 'drums' and drum_decomposition is not null").select("track", "drum_decomposition")
    hits = drums.select("track", F.inline("drum_decomposition.hits"))
    evidence = feel_evidence(series.intervals(hits.select("track", F.col("seconds").alias("t")), "t", keys), keys)
    known = lambda c: F.coalesce(F.col(c), F.lit(False))

    wide = tracks.select("track", "tempo", F.col("arrangement.status").alias("_arranged")).join(there.groupBy("track").agg(*parts), "track", "left")
    wide = wide.withColumn("_bpm", reported_bpm(F.col("tempo.bpm"), F.col("mix_bpm"), F.col("drums_bpm")))
    beats = wide.select("track", (num(60) / grid_bpm(F.col("tempo.bpm"), F.col("drums_bpm"), F.col("mix_bpm"))).alias("_beat"))
    felt = evidence.join(beats, keys)
    felt = felt.select("track", feel_hint(felt, F.col("_beat")).alias("_feel"))

    tonal = {s: {"key": F.col(f"{s}_key"), "scale": F.col(f"{s}_scale"), "confidence": F.col(f"{s}_key_confidence"), "present": known(f"{s}_there"), "silent": known(f"{s}_silent")} for s in ("mix", "bass")}
    grid = drums.select("track", "drum_decomposition.status", "drum_decomposition.steps_per_cycle", F.col("drum_decomposition.unclassified").alias("unclassified"), "drum_decomposition.caveats")
    grid = drum_grid_hint(grid, drums.select("track", F.inline("drum_decomposition.patterns")), keys).withColumnRenamed("note", "_grid_note")
    line = there.filter("source = 'bass' and bass_line is not null").select("track", F.col("bass_line.status").alias("status"), F.explode_outer("bass_line.notes").alias("_n"))
    line = bass_line_hint(line.select("track", "status", "_n.note", "_n.midi", "_n.step"), keys).withColumnRenamed("note", "_line_note")
    bars = tracks.select("track", F.inline("arrangement.sections")).select("track", "start_bar", "length_bars", F.array_join("active", ",").alias("active"), "label")
    gone = tracks.select("track", F.explode("arrangement.absent_sources").alias("source"))
    bars = arrangement_hint(bars, keys, gone).withColumnRenamed("note", "_bars_note")
    played = vocab.sounds(hits.select("track", "cls", "body", "decay"), bass, keys)
    played = played.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("role", "sound", "alternatives"))).alias("sound_suggestions"))
    for part in (felt, grid, line, bars, played):
        wide = wide.join(part, "track", "left")

    drum, low = (density_hint(F.col(f"{s}_density"), known(f"{s}_there"), known(f"{s}_silent"), s) for s in ("drums", "bass"))
    centre = centre_hint(tonal["mix"], tonal["bass"])
    others = F.transform(F.filter("tempo.octave_fits", lambda f: f["ratio"] != F.coalesce(F.col("tempo.ratio"), num(1))), lambda f: f["bpm"])
    compared = F.exists("tempo.octave_fits", lambda f: f["grid"])
    said = notes(
        F.when(~known("mix_there") & ~known("drums_there") & ~known("bass_there"), "no source was analysed, so nothing is suggested"),
        F.col("_bpm.note"),
        tempo_note(F.col("tempo.status"), F.col("tempo.confidence"), F.col("tempo.r")),
        octave_note(F.coalesce("tempo.octave", F.lit("unavailable")), F.col("tempo.ratio"), compared, others),
        F.coalesce(F.col("_feel.note"), F.when(F.col("_feel").isNull(), "too few hits to tell how the beat is cut")),
        drum["note"],
        low["note"],
        centre["note"],
        F.col("_grid_note"),
        F.col("_line_note"),
        F.coalesce(F.col("_bars_note"), F.when(F.col("_arranged") != "ok", F.format_string("the arrangement's status is %s", F.col("_arranged")))),
    )
    hints = F.struct(
        F.col("_bpm.value").alias("bpm"),
        F.col("tempo.status").alias("tempo_status"),
        F.col("tempo.confidence").alias("tempo_confidence"),
        suggest_cycle_seconds(F.col("_bpm.value")).alias("suggested_cycle_seconds"),
        F.col("_feel.value").alias("subdivision_feel"),
        drum["value"].alias("drum_density"),
        low["value"].alias("bass_activity"),
        centre["value"].alias("tonal_centre"),
        "drum_grid",
        "bass_line",
        "arrangement",
        "sound_suggestions",
        said.alias("notes"),
    )
    return wide.select("track", hints.alias("hints"))
