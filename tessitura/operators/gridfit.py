"""Fits a cycle of 16 or 12 steps to hits: anchor, snap, contrast of the folded flux, error, drift.

Everything is by key (a recording): aggregates over hits, and one fold of the flux for each number of
steps. Refusals are statuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import HOP_SECONDS, caveats, finite, num, positive
from tessitura.operators.grid import phase
from tessitura.session import materialize

#: Fixed values.
CANDIDATES, OVERSAMPLE, MIN_CYCLES = (16, 12), 4, 2
IMPROVEMENT, ON_GRID, MOST_ERROR, SNAP_NOTE = 0.10, 0.5, 0.18, 0.10
HALF_HITS, ALL_HITS = 4, 8


def fraction(t: Column, anchor: Column, cycle: Column, steps: Column) -> Column:
    x = (t - anchor) / cycle * steps
    return x - F.rint(x)


def profiles(flux: DataFrame, grids: DataFrame, keys: list[str], fine: int = 1) -> DataFrame:
    """(keys, steps, contrast, on_grid): the best band's, of each grid (keys, steps, cycle, anchor).

    Flux (keys, band, frame, flux) goes to the nearest slot, of which the greatest in each whole cycle and the
    median over the cycles count; fewer than two whole cycles give nothing.
    """
    by = [*keys, "band", "steps"]
    slots = F.col("steps") * fine
    at = F.rint((F.col("frame") * num(HOP_SECONDS) - F.col("anchor")) / (F.col("cycle") / slots)).cast("long")
    hit = flux.join(grids, keys).withColumn("_k", at).filter("_k >= 0").groupBy(*by, "_k").agg(F.max("flux").alias("_v"))
    cycles = hit.groupBy(*by).agg(F.floor((F.max("_k") + 1) / slots).alias("_n")).filter(F.col("_n") >= MIN_CYCLES)
    dense = cycles.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") * slots - 1))).drop("_n")
    level = dense.join(hit, [*by, "_k"], "left").select(*by, F.pmod("_k", slots).alias("slot"), F.coalesce("_v", num(0)).alias("_v"))
    prof = level.groupBy(*by, "slot").agg(F.percentile("_v", num(0.5)).alias("_v"))
    band = prof.groupBy(*by).agg(F.max("_v").alias("_p"), F.avg("_v").alias("_m"), F.sum("_v").alias("_s"), F.sum(F.when(F.pmod("slot", F.lit(fine)) == 0, F.col("_v"))).alias("_on")).filter("_p > 0")
    return band.groupBy(*keys, "steps").agg(F.max(num(1) - F.col("_m") / F.col("_p")).alias("contrast"), F.max(F.col("_on") / F.col("_s")).alias("on_grid"))


def anchored(hits: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """``meta`` with where the grid hangs: a supplied downbeat, else the first beat, else the first hit."""
    first = hits.groupBy(*keys).agg(F.min("t").alias("_first"))
    m = meta.join(first, keys, "left").withColumn("cycle", positive(F.col("cycle_seconds")))
    supplied = F.when(finite(F.col("downbeat_seconds")), F.col("downbeat_seconds"))
    anchor = F.coalesce(supplied, F.col("first_beat_seconds"), F.col("_first"))
    source = F.when(supplied.isNotNull(), "supplied").when(F.col("first_beat_seconds").isNotNull(), "beats").otherwise("first_hit")
    return m.select(*keys, "cycle", F.when(finite(anchor) & F.col("_first").isNotNull(), anchor).alias("anchor0"), source.alias("anchor_source"))


def snapped(hits: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """Grids (keys, steps, cycle, anchor0) moved onto the hits' own phase: ``shift`` in steps, ``anchor``."""
    shift, _ = phase(fraction(F.col("t"), F.col("anchor0"), F.col("cycle"), F.col("steps")))
    s = hits.select(*keys, "t").join(grids, keys).groupBy(*keys, "steps").agg(shift.alias("shift"))
    return grids.join(s, [*keys, "steps"]).withColumn("anchor", F.col("anchor0") + F.col("shift") * F.col("cycle") / F.col("steps"))


def halves(hits: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_error, second_error, drift, implied_cycle): each half of the hits on its own anchor; null with too few hits."""
    span = hits.groupBy(*keys).agg(((F.min("t") + F.max("t")) / num(2)).alias("_mid"))
    h = hits.select(*keys, "t").join(span, keys).join(grids.select(*keys, "steps", "cycle", "anchor"), keys).withColumn("_late", F.col("t") > F.col("_mid"))
    x = fraction(F.col("t"), F.col("anchor"), F.col("cycle"), F.col("steps"))
    shift, _ = phase(x)
    side = h.groupBy(*keys, "steps", "cycle", "anchor", "_late").agg(shift.alias("_s"), F.avg("t").alias("_c"), F.count("*").alias("_n"))
    own = h.join(side.select(*keys, "_late", "_s"), [*keys, "_late"])
    err = own.groupBy(*keys, "_late").agg(F.avg(F.abs(fraction(F.col("t"), F.col("anchor") + F.col("_s") * F.col("cycle") / F.col("steps"), F.col("cycle"), F.col("steps")))).alias("_e"))
    side = side.join(err, [*keys, "_late"])
    pick = lambda c, late: F.max(F.when(F.col("_late") == late, F.col(c)))
    both = side.groupBy(*keys, "steps", "cycle").agg(F.sum("_n").alias("_all"), F.min("_n").alias("_least"), F.count("*").alias("_sides"), *[pick(c, late).alias(f"{c}{int(late)}") for c in ("_s", "_c", "_e") for late in (False, True)])
    both = both.filter((F.col("_sides") == 2) & (F.col("_all") >= ALL_HITS) & (F.col("_least") >= HALF_HITS))
    drift = F.pmod(F.col("_s1") - F.col("_s0") + num(0.5), num(1)) - num(0.5)
    rate = F.col("drift") * F.col("cycle") / F.col("steps") / (F.col("_c1") - F.col("_c0"))
    both = both.withColumn("drift", drift).withColumn("_rate", F.when(F.col("_c1") > F.col("_c0"), rate))
    return both.select(*keys, F.col("_e0").alias("first_error"), F.col("_e1").alias("second_error"), "drift", F.when(F.abs("_rate") < 0.5, F.col("cycle") * (num(1) - F.col("_rate"))).alias("implied_cycle"))


def fit(hits: DataFrame, flux: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key of ``meta`` (keys, cycle_seconds, downbeat_seconds, first_beat_seconds): the grid or why there is none.

    grid_status: ok, no_cycle_length, not_periodic (too little of the flux on the steps), no_fit (hits too far from
    the steps), drifting (each half fits on its own). Twelve steps need a tenth more contrast than sixteen.
    """
    base = anchored(hits, meta, keys)
    each = base.filter("cycle is not null and anchor0 is not null").withColumn("steps", F.explode(F.array(*[F.lit(c) for c in CANDIDATES])))
    tried = snapped(hits, each, keys)
    tried = tried.join(profiles(flux, tried.select(*keys, "steps", "cycle", "anchor"), keys).drop("on_grid"), [*keys, "steps"], "left").withColumn("contrast", F.coalesce("contrast", num(0)))
    tried = materialize(tried, "tried-grids")
    best = lambda n: F.max(F.when(F.col("steps") == n, F.col("contrast")))
    chosen = tried.groupBy(*keys).agg(F.when(best(CANDIDATES[1]) > best(CANDIDATES[0]) * num(1 + IMPROVEMENT), CANDIDATES[1]).otherwise(CANDIDATES[0]).alias("steps"))
    g = materialize(tried.join(chosen, [*keys, "steps"]), "chosen-grids")
    fine = profiles(flux, g.select(*keys, "steps", "cycle", "anchor"), keys, OVERSAMPLE).select(*keys, "on_grid")
    error = hits.select(*keys, "t").join(g.select(*keys, "steps", "cycle", "anchor"), keys).groupBy(*keys).agg(F.avg(F.abs(fraction(F.col("t"), F.col("anchor"), F.col("cycle"), F.col("steps")))).alias("error"))
    g = g.join(fine, keys, "left").join(error, keys, "left").join(halves(hits, g, keys), keys, "left")
    out = base.select(*keys).join(g, keys, "left")
    apart = F.greatest("first_error", "second_error") <= MOST_ERROR
    status = (
        F.when(F.col("cycle").isNull(), "no_cycle_length")
        .when(F.col("on_grid") < ON_GRID, "not_periodic")
        .when(F.col("error") > MOST_ERROR, F.when(apart, "drifting").otherwise("no_fit"))
        .otherwise("ok")
    )
    out = out.withColumn("grid_status", status)
    refused = F.col("grid_status").isin("no_fit", "drifting")
    when = lambda c, cond: F.when(cond, F.col(c)).alias(c)
    notes = caveats(
        (F.abs("shift") >= SNAP_NOTE, F.format_string("the anchor moved %+.2f steps onto the hits' own phase, which changes no step number", F.col("shift"))),
        (F.col("on_grid").isNull() & F.col("cycle").isNotNull(), F.lit("the folded flux could not be read, so the grid rests on the hits alone")),
        (F.col("grid_status") == "no_cycle_length", F.lit("no cycle grid: no usable period, or no hits")),
        (F.col("grid_status") == "not_periodic", F.format_string("no cycle grid: %.2f of the flux falls on the steps, %.2f are needed and %.2f is chance", F.col("on_grid"), num(ON_GRID), num(1 / OVERSAMPLE))),
        (F.col("grid_status") == "no_fit", F.format_string("no cycle grid: hits are %.3f steps off on average, %.2f are allowed", F.col("error"), num(MOST_ERROR))),
        (F.col("grid_status") == "drifting", F.format_string("no cycle grid: each half fits (%.3f, %.3f steps), but they are %+.2f steps apart", F.col("first_error"), F.col("second_error"), F.col("drift"))),
        (refused & F.col("implied_cycle").isNotNull(), F.format_string("a cycle of %.6f s would remove the drift", F.col("implied_cycle"))),
    )
    return out.select(
        *keys,
        "grid_status",
        F.when(F.col("grid_status") == "ok", F.col("steps")).alias("steps_per_cycle"),
        F.col("cycle").alias("cycle_seconds"),
        F.col("anchor").alias("anchor_seconds"),
        F.when(F.col("cycle").isNotNull(), F.col("anchor_source")).alias("anchor_source"),
        F.col("shift").alias("anchor_shift_steps"),
        F.col("error").alias("error_steps"),
        "contrast",
        F.col("on_grid").alias("on_grid_share"),
        *[when(c, refused) for c in ("first_error", "second_error", "drift", "implied_cycle")],
        notes.alias("grid_caveats"),
    )


def place(hits: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with ``step`` and ``cycle``, null where the grid was refused."""
    g = fitted.select(*keys, "steps_per_cycle", "cycle_seconds", "anchor_seconds")
    h = hits.join(g, keys, "left")
    n = F.col("steps_per_cycle").cast("long")
    k = F.rint((F.col("t") - F.col("anchor_seconds")) / F.col("cycle_seconds") * n).cast("long")
    return h.withColumn("step", F.pmod(k, n)).withColumn("cycle", F.floor(k / n)).drop("steps_per_cycle", "cycle_seconds", "anchor_seconds")
