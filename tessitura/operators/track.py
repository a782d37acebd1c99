"""From one written table of frames to a nested row for each source of a track, and one for the track itself.

The parts are plans over the same table. A track's tempo is measured on one source: the drums unless they are silent or
missing, else the mix. Where the drums correlate at several octaves, the drum grid is fitted at each and the octave arbitrated.
Only the grid that results goes from source to source: into the drums, from there into the bass, and into the bars of the arrangement.
Tempo, notes and merged bars take one recording in one group, as each is bounded by its length; the rest is joins and windows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import HOP_SECONDS, caveats, is_silent, num, positive
from tessitura.operators import analysis, arrangement, downbeat, drums, labels, notes, rhythm, series, tempo
from tessitura.session import materialize

KEYS = ["track"]
BEATS = 4
#: The order of classes in a list of hits or patterns.
ORDER = [*drums.CLASSES, "unclassified"]


def grid_source(frames: DataFrame) -> DataFrame:
    """(track, source, is_drums): what the tempo is measured on; null without drums that sound and without a mix."""
    of = lambda s: F.when(F.col("source") == s, F.col("rms"))
    level = frames.groupBy("track").agg(F.avg(of("drums")).alias("_d"), F.count(of("mix")).alias("_m"))
    heard = F.col("_d").isNotNull() & ~is_silent(F.col("_d"))
    source = F.when(heard, "drums").when(F.col("_m") > 0, "mix")
    return level.select("track", source.alias("source"), heard.alias("is_drums"))


def usable(bpm: Column, confidence: Column | None = None) -> Column:
    """A coarse tempo worth refining: positive, and not of negative confidence."""
    sure = F.lit(True) if confidence is None else F.coalesce(confidence >= 0, F.lit(True))
    return F.when(sure, positive(bpm))


def class_order(cls: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in ORDER]), cls)


class Track:
    """The parts of the analysis of tracks, each made when it is asked for and read by those that need it.

    ``frames`` has (track, source, frame, rms, power and the bands kick, body, noise, air, tempo); ``coarse`` has
    (track, bpm, r), the tempo that the mix is heard at; ``f0`` has (track, frame, f0_hz, voiced, voiced_prob) of the bass.
    """

    def __init__(self, frames: DataFrame, coarse: DataFrame | None = None, f0: DataFrame | None = None, hop: float = HOP_SECONDS):
        self.frames, self.hop = frames, hop
        self.given, self.f0 = coarse, f0

    @cached_property
    def source(self) -> DataFrame:
        return grid_source(self.frames)

    @cached_property
    def coarse(self) -> DataFrame:
        """(track, coarse): the tempo to refine, null where the mix has none."""
        t = self.given if self.given is not None else rhythm.coarse_tempo(self.frames.filter("source = 'mix'"), KEYS, self.hop)
        return self.source.select("track").join(t, "track", "left").select("track", usable(F.col("bpm"), F.col("r")).alias("coarse"))

    @cached_property
    def heard_on(self) -> DataFrame:
        """(track, frame, low, bright, flux, coarse) of each track's grid source."""
        f = self.frames.join(self.source.filter("source is not null"), ["track", "source"])
        f = series.flux(f.select("track", "frame", "is_drums", F.col("tempo").alias("low"), F.col("air").alias("bright")), "low", KEYS)
        return materialize(f.join(self.coarse, "track"), "grid-source")

    @cached_property
    def first_fit(self) -> DataFrame:
        """(track, bpm, status, r, confidence, octave, stability) at the coarse tempo."""
        return materialize(tempo.refine(self.heard_on, KEYS, self.hop), "tempo-fits")

    @cached_property
    def octaves(self) -> DataFrame:
        """(track, ratio, bpm, live) where the octave is open: drums, a refined tempo, several live ones with the tempo's own among them."""
        open_ = self.first_fit.filter("status = 'refined'").select("track")
        e = self.heard_on.filter("is_drums").join(open_, "track", "left_semi")
        c = tempo.octave_candidates(e, KEYS, self.hop)
        several = c.filter("live").groupBy("track").agg(F.count("*").alias("_n"), F.max(F.col("ratio") == 1.0).alias("_own")).filter("_n > 1 and _own")
        return materialize(c.join(several.select("track"), "track", "left_semi"), "octaves")

    @cached_property
    def heard(self):
        """What the drums hold before any tempo: hits, detections, flux and gates; of silent drums nothing."""
        live = self.source.filter("is_drums").select("track")
        f = self.frames.filter("source = 'drums'").join(live, "track", "left_semi")
        return drums.hear(f.select("track", "frame", *drums.BANDS), KEYS)

    @cached_property
    def octave_fits(self) -> DataFrame:
        """(track, ratio, bpm, grid, error_steps, error_seconds): the drum grid at each live octave, with a downbeat of its own."""
        live = self.octaves.filter("live").select("track", "ratio", (num(60) / F.col("bpm")).alias("period_seconds"))
        by = ["track", "ratio"]
        env = self.heard_on.select("track", "frame", "low", "bright").join(live.select(*by), "track")
        at = downbeat.find_downbeat(env, live, by, self.hop, BEATS).select(*by, F.col("offset_seconds").alias("downbeat_seconds"))
        hits, _, flux, _ = self.heard
        return materialize(tempo.octave_fits(hits, flux, self.octaves, KEYS, BEATS, at), "octave-fits")

    @cached_property
    def octave(self) -> DataFrame:
        """(track, ratio, bpm, compared, caveat, fits) of the octaves that were open."""
        row = F.struct("ratio", "bpm", "grid", "error_steps", "error_seconds")
        rows = self.octave_fits.groupBy("track").agg(F.array_sort(F.collect_list(row)).alias("fits"), F.max("grid").alias("_any"))
        a = tempo.arbitrate_octave(self.octave_fits, KEYS).join(rows, "track")
        stayed = F.when(F.col("_any"), F.lit("the drum grid was fitted at each octave and the tempo's own fits best")).otherwise(F.lit("no octave gives a drum grid, so nothing here can tell whether the tempo's own is right"))
        return a.select("track", "ratio", "bpm", "compared", F.when(F.col("ratio") == 1.0, stayed).otherwise(F.col("caveat")).alias("caveat"), "fits")

    @cached_property
    def tempo(self) -> DataFrame:
        """(track, is_drums, coarse, tempo fields, period_seconds, ratio, octave_fits, caveats); a moved octave is refined anew."""
        moved = self.octave.filter("ratio <> 1").select("track", F.col("bpm").alias("coarse"))
        again = tempo.refine(self.heard_on.drop("coarse").join(moved, "track"), KEYS, self.hop)
        fits = self.first_fit.join(moved.select("track"), "track", "left_anti").unionByName(again)
        t = self.source.join(self.coarse, "track").join(fits, "track", "left").join(self.octave.select("track", "ratio", F.col("fits").alias("octave_fits"), "caveat"), "track", "left")
        t = t.withColumn("status", F.coalesce("status", F.lit("unavailable"))).withColumn("confidence", F.coalesce("confidence", F.lit("low")))
        said = caveats(
            (F.col("source").isNull(), F.lit("there are no drums that sound and no mix to measure a tempo on")),
            (F.col("error").isNotNull(), F.concat(F.lit("the tempo could not be measured: "), F.col("error"))),
            (F.col("caveat").isNotNull(), F.col("caveat")),
            (~F.col("is_drums") & (F.col("status") != "unavailable"), F.lit("the tempo is the mix's: its low band carries more than drums, and the octave could not be tried on a drum grid")),
        )
        return materialize(t.withColumn("period_seconds", num(60) / positive(F.col("bpm"))).withColumn("caveats", said).drop("caveat", "error"), "tempos")

    @cached_property
    def downbeat(self) -> DataFrame:
        env = self.heard_on.select("track", "frame", "low", "bright")
        return materialize(downbeat.find_downbeat(env, self.tempo.select("track", "period_seconds"), KEYS, self.hop, BEATS), "downbeats")

    @cached_property
    def grid(self) -> DataFrame:
        """(track, period_seconds, downbeat_seconds): what goes from the track to its sources."""
        return self.tempo.select("track", "is_drums", "status", "confidence", "period_seconds").join(self.downbeat.select("track", F.col("offset_seconds").alias("downbeat_seconds")), "track", "left")

    @cached_property
    def drum_parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        meta = self.grid.filter("is_drums").select("track", (F.col("period_seconds") * BEATS).alias("cycle_seconds"), "downbeat_seconds", F.lit(None).cast("double").alias("first_beat_seconds"))
        hits, patterns, summary = drums.on_grid(self.heard, meta, KEYS)
        return materialize(hits, "hits"), patterns, materialize(summary, "drum-summaries")

    @cached_property
    def drum_blocks(self) -> DataFrame:
        """(track, drum_decomposition) of tracks with drums; hits by frame and class, patterns by class."""
        hits, patterns, summary = self.drum_parts
        order = class_order(F.col("cls"))
        listed = hits.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("frame", order.alias("_o"), "t", "cls", "confidence", "step", "cycle", "band", "body", "decay"))).alias("hits"))
        listed = listed.select("track", F.transform("hits", lambda h: F.struct(h["t"].alias("seconds"), h["cls"].alias("cls"), h["confidence"].alias("confidence"), h["step"].alias("step"), h["cycle"].alias("cycle"), h["body"].alias("body"), h["decay"].alias("decay"))).alias("_hits"))
        p = patterns.groupBy("track").agg(F.array_sort(F.collect_list(F.struct(order.alias("_o"), "cls", "hit_count", "steps", "occupancy"))).alias("_p"))
        p = p.select("track", F.transform("_p", lambda x: x.dropFields("_o")).alias("_patterns"))
        there = self.frames.filter("source = 'drums'").select("track").distinct().join(self.source.select("track", "is_drums"), "track")
        s = there.join(summary, "track", "left").join(listed, "track", "left").join(p, "track", "left")
        status = F.when(~F.col("is_drums"), "silent").otherwise(F.col("status"))
        said = F.when(F.col("is_drums"), F.col("caveats")).otherwise(F.array(F.lit("below the silence floor, so no hits were looked for")))
        rest = [c for c in summary.columns if c not in ("track", "status", "caveats", "hits")]
        doc = F.struct(status.alias("status"), F.coalesce("_hits", F.array().cast(listed.schema["_hits"].dataType)).alias("hits"), F.coalesce("_patterns", F.array().cast(p.schema["_patterns"].dataType)).alias("patterns"), *rest, said.alias("caveats"))
        return s.select("track", doc.alias("drum_decomposition"))

    @cached_property
    def bass_grid(self) -> DataFrame:
        """What ``notes.resolved`` takes: the drums' own grid where it holds, else the track's beat and downbeat."""
        s = self.drum_parts[2].filter("status = 'ok'").select("track", "anchor_seconds", (F.col("cycle_seconds") / F.col("steps_per_cycle")).alias("step_seconds"), "steps_per_cycle")
        return self.grid.join(s, "track", "left").select("track", "anchor_seconds", "step_seconds", "steps_per_cycle", F.col("period_seconds").alias("beat_period_seconds"), "downbeat_seconds")

    @cached_property
    def bass_blocks(self) -> DataFrame:
        """(track, bass_line) of tracks with a bass."""
        wanted = self.frames.filter("source = 'bass'").groupBy("track").agg(is_silent(F.avg("rms")).alias("silent"))
        f0 = self.f0 if self.f0 is not None else wanted.sparkSession.createDataFrame([], "track string, frame bigint, f0_hz double, voiced boolean, voiced_prob double")
        return notes.bass_line(f0, self.bass_grid, wanted, KEYS, self.hop)

    @cached_property
    def arrangement(self) -> DataFrame:
        """(track, arrangement): stems by level, the kick by the drums' lowest band."""
        stems = self.frames.filter(F.col("source").isin(*arrangement.STEMS)).select("track", "source", "frame", F.col("rms").alias("level"))
        kick = self.frames.filter("source = 'drums'").select("track", F.lit(arrangement.KICK).alias("source"), "frame", F.col("kick").alias("level"))
        g = self.grid.select("track", tempo.bar_period(F.col("period_seconds"), F.col("status"), F.col("is_drums")).alias("beat_period_seconds"), "downbeat_seconds", tempo.grid_confidence(F.col("status"), F.col("confidence")).alias("trust"))
        return arrangement.arrange(stems.unionByName(kick), g, KEYS, self.hop)

    def tracks(self) -> DataFrame:
        """(track, tempo, downbeat, arrangement): one nested row for each track."""
        t = self.tempo.select("track", F.struct(*[c for c in self.tempo.columns if c != "track"]).alias("tempo"))
        d = self.downbeat.select("track", F.struct(*[c for c in self.downbeat.columns if c != "track"]).alias("downbeat"))
        return t.join(d, "track", "left").join(self.arrangement, "track", "left")

    def sources(self, described: DataFrame) -> DataFrame:
        """One nested row for each (track, source) of ``described`` (the result of ``analysis.analyse``), missing ones included.

        Blocks of descriptors, drum_decomposition (of drums), bass_line (of the bass), labels, and what is unavailable.
        """
        d = described
        quiet = is_silent(F.col("rms_mean"))
        blocks = [F.struct(*fs).alias(b) for b, fs in analysis.BLOCKS.items()]
        drum = self.drum_blocks.withColumn("source", F.lit("drums"))
        bass = self.bass_blocks.withColumn("source", F.lit("bass"))
        # a source that isn't there has no labels
        shown = labels.ordered(labels.label(d.filter("status = 'ok'"), analysis.KEYS), analysis.KEYS)
        out = d.join(drum, analysis.KEYS, "left").join(bass, analysis.KEYS, "left").join(shown, analysis.KEYS, "left")
        attempted = lambda block: F.coalesce(F.col(block)["status"], F.lit("not_attempted"))
        failed = {b: attempted(b) for b in ("drum_decomposition", "bass_line")}
        extra = F.array_compact(F.array(F.when(quiet, F.format_string("source (silent: %.2g)", F.col("rms_mean")))))
        gone = F.array_sort(F.concat(analysis.unavailable(analysis.BLOCKS, failed), extra))
        return out.select(*analysis.KEYS, "status", "seconds", quiet.alias("silent"), *blocks, "drum_decomposition", "bass_line", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), gone.alias("unavailable_features"))


def from_sound(frames: DataFrame, f0: DataFrame, levels: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of sources, rows of tracks) from the frames, pitch and levels of recordings; ``wanted`` has (track, source)."""
    frames = materialize(frames, "sound-frames")
    described = materialize(analysis.described(frames, levels, wanted), "descriptors")
    mix = described.filter("source = 'mix'").select("track", "bpm", F.lit(None).cast("double").alias("r"))
    t = Track(frames, mix, f0.filter("source = 'bass'").drop("source"))
    return t.sources(described), t.tracks()
