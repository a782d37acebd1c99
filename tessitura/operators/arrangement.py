"""Sections of a track from the sources present in each bar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import caveats, clean, finite, num, positive
from tessitura.operators import series
from tessitura.session import materialize

#: Fixed values.
MIN_BARS, BEATS_PER_BAR, FINAL_BAR = 2, 4, 0.5
PRESENT, REFERENCE, ACTIVE = 0.15, 0.9, 0.02
STEMS, KICK = ["drums", "bass", "vocals", "other"], "kick"
#: Grids by which bars are approximate.
WEAK = ["low", "coarse", "unavailable", "unknown"]
EMPTY = "cast(array() as array<struct<start_bar:int,length_bars:int,start_seconds:double,active:array<string>,label:string,reason:string>>)"


def bar_count(frames: Column, hop: Column, bar: Column, offset: Column) -> Column:
    """Whole bars after the offset; a last one counts from half its length on."""
    span = frames * hop - offset
    whole = F.floor(span / bar)
    return F.when(span > 0, whole + (span - whole * bar >= num(FINAL_BAR) * bar).cast("long")).otherwise(F.lit(0).cast("long"))


def bar_levels(frames: DataFrame, grid: DataFrame, keys: list[str], hop: float, power_of: tuple[str, ...] = (KICK,), beats: int = BEATS_PER_BAR) -> DataFrame:
    """(keys, source, bar, level, bars) from frame levels (keys, source, frame, level) and a grid (keys, beat_period_seconds, downbeat_seconds).

    RMS over the frames of each bar; sources in ``power_of`` hold power already. Bars are as many as the
    shortest source has; edges are rounded half to even. A grid without a period, or less than a bar, gives no rows.
    """
    offset = F.when(finite(F.col("downbeat_seconds")) & (F.col("downbeat_seconds") >= 0), F.col("downbeat_seconds")).otherwise(num(0))
    g = grid.select(*keys, (positive(F.col("beat_period_seconds")) * num(beats)).alias("bar_seconds"), offset.alias("offset")).filter("bar_seconds is not null")
    shortest = frames.groupBy(*keys, "source").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_n"))
    g = g.join(shortest, keys).withColumn("bars", bar_count(F.col("_n"), num(hop), F.col("bar_seconds"), F.col("offset"))).filter("bars > 0")
    edge = lambda bar: F.rint((F.col("offset") + bar * F.col("bar_seconds")) / num(hop))
    rows = frames.join(g, keys).filter((F.col("frame") >= edge(num(0))) & (F.col("frame") < F.least(edge(F.col("bars")), F.col("_n"))))
    # the edges are rounded, so the quotient may be off by one either way
    guess = F.greatest(num(0), F.floor((F.col("frame") * num(hop) - F.col("offset")) / F.col("bar_seconds")).cast("double"))
    bar = F.when(F.col("frame") >= edge(guess + 1), guess + 1).when(F.col("frame") < edge(guess), guess - 1).otherwise(guess)
    x = clean(F.col("level"))
    power = F.when(F.col("source").isin(*power_of), F.greatest(x, num(0))).otherwise(x * x)
    return rows.withColumn("bar", bar.cast("long")).groupBy(*keys, "source", "bar").agg(F.sqrt(F.avg(power)).alias("level"), F.first("bars").alias("bars"))


def presence(levels: DataFrame, keys: list[str], kick: str = KICK, drums: str = "drums") -> DataFrame:
    """(keys, source, bar, present, absent, threshold) from bar levels (keys, source, bar, level).

    A source is absent if its 90th percentile is under a fiftieth of the loudest's, as all are if none sounds;
    the kick, part of the drums, has no say there and is absent when the drums are. A threshold of 0 is never reached.
    """
    by_track = Window.partitionBy(*keys)
    b = series.with_quantile(levels, "_ref", "level", REFERENCE, [*keys, "source"])
    stem = F.col("source") != kick
    b = b.withColumn("_top", F.max(F.when(stem, F.col("_ref"))).over(by_track))
    b = b.withColumn("_out", F.coalesce(F.col("_ref") / F.nullif(F.col("_top"), num(0)), num(0)) < num(ACTIVE))
    inherited = F.coalesce(F.max(F.when(F.col("source") == drums, F.col("_out"))).over(by_track), F.lit(False))
    b = b.withColumn("absent", F.when(stem, F.col("_out")).otherwise(inherited)).withColumn("threshold", num(PRESENT) * F.col("_ref"))
    return b.withColumn("present", ~F.col("absent") & (F.col("threshold") > 0) & (F.col("level") >= F.col("threshold"))).drop("_ref", "_top", "_out")


def merge(patterns: list[frozenset], least: int = MIN_BARS) -> list[tuple[int, int, frozenset]]:
    """Runs of equal patterns; the shortest below ``least`` bars joins the neighbour that differs
    in the fewest tracks, then the longer, then the earlier; equal neighbours become one."""
    runs: list[list] = []

    def push(n, p):
        if runs and runs[-1][1] == p:
            runs[-1][0] += n
        else:
            runs.append([n, p])

    for p in patterns:
        push(1, p)
    while len(runs) > 1:
        i = min(range(len(runs)), key=lambda j: (runs[j][0], j))
        if runs[i][0] >= least:
            break
        beside = [j for j in (i - 1, i + 1) if 0 <= j < len(runs)]
        to = min(beside, key=lambda j: (len(runs[i][1] ^ runs[j][1]), -runs[j][0], j))
        runs[to][0] += runs[i][0]
        rest = [r for j, r in enumerate(runs) if j != i]
        runs = []
        for n, p in rest:
            push(n, p)
    out, at = [], 0
    for n, p in runs:
        out.append((at, n, p))
        at += n
    return out


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_bar, length_bars, active) from (keys, bar, source, present); bars that are missing have nothing present."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_bar = pdf[pdf["present"]].groupby("bar")["source"].agg(frozenset)
        bars = range(int(pdf["bar"].min()), int(pdf["bar"].max()) + 1)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "start_bar": a, "length_bars": n, "active": ",".join(sorted(p))} for a, n, p in merge([by_bar.get(b, frozenset()) for b in bars])])

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_bar int, length_bars int, active string")


def named(merged_: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with ``label`` and ``reason``, by windows over the sections of a track.

    What a section is called follows from its place (first; after the last with all sources; in between), what is missing in
    it, and whether the one before is a breakdown, which itself looks at no other section.
    """
    parts = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    bands = merged_.select(*keys, F.explode(parts("active")).alias("_x")).groupBy(*keys).agg(F.array_sort(F.collect_set("_x")).alias("_band"))
    by_track, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("start_bar")
    s = merged_.join(bands, keys, "left").withColumn("_on", parts("active")).withColumn("_band", F.coalesce("_band", F.array().cast("array<string>")))
    s = s.withColumn("_i", F.row_number().over(in_order)).withColumn("_all", F.size("_on") == F.size("_band"))
    last = F.coalesce(F.max(F.when(F.col("_all"), F.col("_i"))).over(by_track), F.count("*").over(by_track) - 1)
    s = s.withColumn("_place", F.when(F.col("_i") == 1, "first").when(F.col("_i") > last, "tail").otherwise("inner"))
    rhythmless = F.array_contains("_band", KICK) & ~F.array_contains("_on", KICK) & ~F.array_contains("_on", "bass")
    s = s.withColumn("_gap", (F.size("_on") > 0) & (F.col("_place") == "inner") & rhythmless)
    resumed = F.coalesce(F.lag("_gap").over(in_order), F.lit(False))
    label = (
        F.when(F.size("_on") == 0, "silence")
        .when(F.col("_all"), F.when(resumed, "drop").otherwise("full"))
        .when(F.col("_place") == "first", "intro")
        .when(F.col("_place") == "tail", "outro")
        .when(F.col("_gap"), "breakdown")
        .otherwise("groove")
    )
    s = s.withColumn("label", label)
    playing, band = F.array_join("_on", ", "), F.array_join("_band", ", ")
    texts = {
        "silence": F.lit("nothing plays"),
        "drop": F.concat(F.lit("all of "), band, F.lit(" return after a breakdown")),
        "full": F.concat(F.lit("all sources of the recording play: "), band),
        "intro": F.concat(F.lit("the opening, without all of "), band, F.lit("; playing "), playing),
        "outro": F.concat(F.lit("nothing after it has all of "), band, F.lit("; playing "), playing),
        "breakdown": F.concat(F.lit("inside the recording, without kick and bass; playing "), playing),
        "groove": F.concat(F.lit("playing "), playing),
    }
    reason = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in texts.items()])
    return s.withColumn("reason", reason).drop("_band", "_on", "_i", "_all", "_place", "_gap")


def sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_bar, length_bars, active, label, reason) from (keys, bar, source, present)."""
    return named(materialize(merged(df, keys), "merged-sections"), keys)  # read twice


def arrange(frames: DataFrame, grid: DataFrame, keys: list[str], hop: float) -> DataFrame:
    """(keys, arrangement) for each row of ``grid`` (keys, beat_period_seconds, downbeat_seconds, trust): status, bars, sections and caveats.

    ``frames`` are levels (keys, source, frame, level) of the stems and the kick. Without a period the status is no_grid,
    with less than a bar too_short. ``trust`` is how far the grid holds; a weak one is said.
    """
    levels = materialize(bar_levels(frames, grid, keys, hop), "bar-levels")
    found = materialize(presence(levels, keys), "presence")
    s = sections(found.select(*keys, "source", F.col("bar"), "present"), keys)
    g = grid.select(*keys, "trust", positive(F.col("beat_period_seconds")).alias("_beat"), F.when(finite(F.col("downbeat_seconds")) & (F.col("downbeat_seconds") >= 0), F.col("downbeat_seconds")).otherwise(num(0)).alias("_from"))
    start = F.col("_from") + F.col("start_bar") * F.col("_beat") * num(BEATS_PER_BAR)
    s = s.join(g, keys).select(*keys, F.struct("start_bar", "length_bars", start.alias("start_seconds"), F.filter(F.split("active", ","), lambda x: x != "").alias("active"), "label", "reason").alias("_s"))
    s = s.groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias("sections"))
    many = levels.groupBy(*keys).agg(F.max("bars").alias("bar_count"))
    gone = found.filter("absent").groupBy(*keys).agg(F.array_sort(F.collect_set("source")).alias("absent"))
    out = g.join(s, keys, "left").join(many, keys, "left").join(gone, keys, "left")
    status = F.when(F.col("_beat").isNull(), "no_grid").when(F.col("bar_count").isNull(), "too_short").otherwise("ok")
    notes = caveats(
        (F.col("_beat").isNull(), F.lit("no bars: the tempo isn't refined and there are no drums to count bars by")),
        (F.col("trust").isin(*WEAK), F.format_string("the bar grid is %s, so sections begin at about the bar that is named", F.col("trust"))),
        (F.size("absent") > 0, F.concat(F.lit("taken as not in this recording, being under a fiftieth of the loudest stem: "), F.array_join("absent", ", "))),
    )
    bar = F.col("_beat") * num(BEATS_PER_BAR)
    doc = F.struct(status.alias("status"), F.coalesce("bar_count", F.lit(0)).cast("long").alias("bar_count"), bar.alias("bar_seconds"), F.coalesce("sections", F.expr(EMPTY)).alias("sections"), F.coalesce("absent", F.array().cast("array<string>")).alias("absent_sources"), notes.alias("caveats"))
    return out.select(*keys, doc.alias("arrangement"))
