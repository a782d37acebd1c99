"""Drum hits: from detections in four bands to classed hits on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import HOP_SECONDS, air_over_noise, caveats, num, score
from tessitura.operators import grid, gridfit, series
from tessitura.session import materialize

#: Affinity of a detecting band with kick, snare, hat; floors and margins.
AFFINITY = {"kick": (1.0, 0.4, 0.0), "body": (0.4, 1.0, 0.0), "noise": (0.0, 1.0, 0.5), "air": (0.0, 0.3, 1.0)}
BANDS, CLASSES = list(AFFINITY), ["kick", "snare", "hat"]
FLOOR, MARGIN, SEPARATION = 0.15, 0.10, 3
SHARE, PEAK, SPARSITY, NEAR_ZERO = 1e-3, 1.0, 0.72, 0.02
BLEED_DOMINANCE, BLEED_AIR, BLEED_BANDS = 0.60, 0.50, ("noise", "air")
WINDOW, ATTACK, MOST_DECAY = 22, 3, 100.0
MOSTLY, SURVIVAL = 0.25, 0.5


def class_scores(band: Column, shapes: dict[str, Column]) -> dict[str, Column]:
    """Shape times affinity for each class."""
    out = {}
    for i, c in enumerate(CLASSES):
        a = F.when(band == "kick", num(AFFINITY["kick"][i]))
        for b in ("body", "noise", "air"):
            a = a.when(band == b, num(AFFINITY[b][i]))
        out[c] = shapes[c] * a
    return out


def decide(scores: dict[str, Column]) -> Column:
    """struct(cls, confidence): the best class over the floor and clear of the next; else unclassified with the next's score."""
    s = F.array_sort(F.array(*[F.struct((-v).alias("s"), F.lit(k).alias("n")) for k, v in scores.items()]))
    first, second = s[0], s[1]
    clear = (-first["s"] >= FLOOR) & (second["s"] - first["s"] >= MARGIN)
    return F.struct(F.when(clear, first["n"]).otherwise(F.lit("unclassified")).alias("cls"), F.when(clear, -first["s"]).otherwise(-second["s"]).alias("confidence"))


def shapes(kick: Column, body: Column, noise: Column, air: Column, decay: Column) -> dict[str, Column]:
    """Shape scores from a hit's shares of energy and its decay ratio."""
    return {"kick": score(kick, 0.60, 0.90), "snare": score(body, 0.25, 0.55), "hat": F.least(score(decay, 16.0, 3.0), score(air_over_noise(air, noise), 0.015, 0.060))}


def gates(flux: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, band, share, peak, sparsity, refusal) from band envelopes with their flux.

    A band is searched if it has a thousandth of the energy, one rise of 1 or more, and is near zero most of
    the time; else ``refusal`` says why not: empty, no_transient, not_sparse.
    """
    by_band = [*keys, "band"]
    f = flux.withColumn("_peak", F.max("flux").over(Window.partitionBy(*by_band)))
    a = f.groupBy(*by_band).agg(F.sum(value).alias("_e"), F.first("_peak").alias("peak"), F.avg((F.col("flux") <= num(NEAR_ZERO) * F.col("_peak")).cast("double")).alias("sparsity"))
    share = F.coalesce(F.col("_e") / F.nullif(F.sum("_e").over(Window.partitionBy(*keys)), num(0)), num(0))
    why = F.when(F.col("share") < SHARE, "empty").when(F.col("peak") < PEAK, "no_transient").when(F.col("sparsity") < SPARSITY, "not_sparse")
    return a.withColumn("share", share).withColumn("refusal", why).drop("_e")


def measure(peaks: DataFrame, frames: DataFrame, keys: list[str], window: int = WINDOW, attack: int = ATTACK) -> DataFrame:
    """Shares of energy by band for each peak, and how its own band decays, over the frames to the next peak of
    that band or ``window``, by prefix sums."""
    w = Window.partitionBy(*keys, "band").orderBy("frame")
    last = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("_end"))
    spans = peaks.withColumn("_next", F.lead("frame").over(w)).join(last, keys)
    end = F.greatest(F.col("frame") + 1, F.least(F.col("frame") + window, F.coalesce("_next", F.col("_end")), F.col("_end")))
    spans = spans.withColumn("end", end).withColumn("mid", F.least(F.col("frame") + attack, F.col("end")))
    before = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    upto = frames.select(*keys, (F.col("frame") + 1).alias("_at"), *[F.sum(b).over(before).alias(f"c_{b}") for b in BANDS])
    zero = frames.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_at"), *[num(0).alias(f"c_{b}") for b in BANDS])
    upto = upto.unionByName(zero)
    for name, at in (("s", "frame"), ("m", "mid"), ("e", "end")):
        side = upto.select(*keys, F.col("_at").alias(at), *[F.col(f"c_{b}").alias(f"{name}_{b}") for b in BANDS])
        spans = spans.join(side, [*keys, at])

    def own(side: str) -> Column:
        out = F.when(F.col("band") == BANDS[0], F.col(f"{side}_{BANDS[0]}"))
        for b in BANDS[1:]:
            out = out.when(F.col("band") == b, F.col(f"{side}_{b}"))
        return out

    part = {b: F.col(f"e_{b}") - F.col(f"s_{b}") for b in BANDS}
    total = part["kick"] + part["body"] + part["noise"] + part["air"]
    head = (own("m") - own("s")) / (F.col("mid") - F.col("frame"))
    tail = (own("e") - own("m")) / F.nullif(F.col("end") - F.col("mid"), F.lit(0))
    # differences of prefix sums leave a trifle where there is nothing
    silent = tail <= num(1e-12) * own("e")
    decay = F.when((head > 0) & tail.isNotNull(), F.when(silent, num(MOST_DECAY)).otherwise(F.least(num(MOST_DECAY), F.sqrt(head / tail))))
    return spans.select(*keys, "band", "frame", "flux", *[F.when(total > 0, part[b] / total).alias(b) for b in BANDS], decay.alias("decay"))


def melt(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.select(*keys, "frame", F.inline(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("value")) for b in BANDS])))


def detect(frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classed detections (keys, band, frame, shares, decay, cls, confidence), the flux of the bands searched, and the gates."""
    by_band = [*keys, "band"]
    flux = series.flux(melt(frames, keys), "value", by_band)
    gate = gates(flux, keys)
    searched = flux.join(gate.filter("refusal is null").select(*by_band), by_band, "left_semi")
    hits = measure(series.peaks(searched, keys=by_band).select(*by_band, "frame", "flux"), frames, keys)
    d = decide(class_scores(F.col("band"), shapes(F.col("kick"), F.col("body"), F.col("noise"), F.col("air"), F.col("decay"))))
    hits = hits.withColumn("_d", d).select("*", F.col("_d.cls").alias("cls"), F.col("_d.confidence").alias("confidence")).drop("_d")
    # the kick's own transient, found again in an upper band, is no hat
    near_kick = series.near(hits, F.col("band") == "kick", SEPARATION - 1, keys)
    hits = hits.withColumn("_near", near_kick)
    bleed = F.col("band").isin(*BLEED_BANDS) & (F.col("cls") != "unclassified") & F.col("_near") & (F.col("kick") >= BLEED_DOMINANCE) & F.coalesce(air_over_noise(F.col("air"), F.col("noise")) < BLEED_AIR, F.lit(True))
    bleed = F.coalesce(bleed, F.lit(False))
    hits = hits.withColumn("bleed", bleed).withColumn("cls", F.when(F.col("bleed"), "unclassified").otherwise(F.col("cls"))).drop("_near")
    return hits, searched, gate


def resolve(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Of one class within three frames the most confident stays, in the order (frame, band); then what has no class goes beside what has."""
    kept = series.spaced(hits, SEPARATION, [*keys, "cls"], "confidence", ("band",))
    kept = kept.withColumn("_near", series.near(kept, F.col("cls") != "unclassified", SEPARATION - 1, keys))
    return kept.filter((F.col("cls") != "unclassified") | ~F.col("_near")).drop("_near")


def patterns(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cls, hit_count, steps, occupancy) from hits with their ``step`` and ``cycle`` (null without a grid)."""
    many = hits.groupBy(*keys, "cls").agg(F.count("*").alias("hit_count"))
    on = grid.occupancy(hits.filter("step is not null"), [*keys, "cls"], "step", "cycle")
    steps = on.groupBy(*keys, "cls").agg(F.array_sort(F.collect_list(F.struct("step", F.least(num(1), F.col("occupancy")).alias("occupancy")))).alias("_s"))
    return many.join(steps, [*keys, "cls"], "left").select(*keys, "cls", "hit_count", F.coalesce(F.col("_s.step"), F.array().cast("array<long>")).alias("steps"), F.coalesce(F.col("_s.occupancy"), F.array().cast("array<double>")).alias("occupancy"))


def hear(frames: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hits with their time, all detections, flux of the bands searched, gates), written: what doesn't depend on a tempo."""
    # each of these is read many times
    found, flux, gate = detect(materialize(frames, "frames"), keys)
    found, flux = materialize(found, "detections"), materialize(flux.select(*keys, "band", "frame", "flux"), "flux")
    hits = materialize(resolve(found, keys).withColumn("t", F.col("frame") * num(HOP_SECONDS)), "hits")
    return hits, found, flux, gate


def decompose(frames: DataFrame, meta: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``on_grid`` of what is heard in ``frames`` (keys, frame, kick, body, noise, air)."""
    return on_grid(hear(frames, keys), meta, keys)


def on_grid(heard: tuple[DataFrame, DataFrame, DataFrame, DataFrame], meta: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits, patterns and one summary row for each key of ``meta``.

    ``meta`` has (keys, cycle_seconds, downbeat_seconds, first_beat_seconds), null where unknown. Hits: (keys, frame, t, cls,
    confidence, step, cycle, shares, decay). The summary has the status (ok, no_grid, too_few_hits), the grid's figures, counts and caveats.
    """
    hits, found, flux, gate = heard
    fitted = materialize(gridfit.fit(hits, flux, meta, keys), "grids")
    hits = gridfit.place(hits, fitted, keys)
    per_class = patterns(hits, keys)

    counts = hits.groupBy(*keys).agg(F.count("*").alias("hits"), F.count(F.when(F.col("cls") == "unclassified", 1)).alias("unclassified"))
    of_kick = F.col("band") == "kick"
    early = found.groupBy(*keys).agg(F.count(F.when(F.col("bleed"), 1)).alias("bleed"), F.count(F.when(of_kick, 1)).alias("kicks_found"), F.count(F.when(of_kick & (F.col("cls") == "kick"), 1)).alias("kicks_kept"))
    dormant = gate.filter("refusal is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "band", "refusal"))).alias("dormant"))
    out = meta.select(*keys).join(fitted, keys, "left").join(counts, keys, "left").join(early, keys, "left").join(dormant, keys, "left")
    n, loose = F.coalesce("hits", F.lit(0)), F.coalesce("unclassified", F.lit(0))
    notes = caveats(
        (F.size("dormant") > 0, F.concat(F.lit("bands not searched: "), F.array_join("dormant", ", "))),
        (n == 0, F.lit("no drum hits detected")),
        (F.col("bleed") > 0, F.format_string("%d detections in the upper bands were the kick's own transient", F.col("bleed"))),
        (loose > 0, F.format_string("%d of %d hits are unclassified: three classes do not make a full kit", loose, n)),
        (loose > num(MOSTLY) * n, F.lit("so many hits are unclassified that the pattern is a partial transcription")),
        ((F.col("kicks_found") > 0) & (F.col("kicks_kept") / F.col("kicks_found") < SURVIVAL), F.format_string("of %d hits in the kick band only %d classified as kicks", F.col("kicks_found"), F.col("kicks_kept"))),
    )
    status = F.when(n == 0, "too_few_hits").when(F.col("grid_status") == "ok", "ok").otherwise("no_grid")
    figures = [c for c in fitted.columns if c not in keys and c != "grid_caveats"]
    out = out.withColumn("caveats", F.concat(notes, F.coalesce("grid_caveats", F.array().cast("array<string>"))))
    return hits, per_class, out.select(*keys, status.alias("status"), n.alias("hits"), loose.alias("unclassified"), *figures, "caveats")
