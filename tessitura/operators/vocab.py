"""Sounds that stand for measured hits and bass: kick, snare, hat, bass line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.scalars import evidence, num
from tessitura.operators.series import with_mean_in_order

#: Fixed values.
SHELL_BODY, CLOSED_DECAY = 0.15, 4.0
SUB, HARMONIC = (0.75, 0.005, 250.0), (0.55, 0.12, 180.0)
PALETTE = ["ht", "mt", "lt", "cr", "rd", "perc", "sh", "cb", "tb"]


def drum_sound(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cls, sound, offers, hits, evidence) per class of hits (cls, body, decay) by their medians and means, with how many they are.

    Where hits say their ``place``, means are summed in that order.
    """
    body = F.avg("body")
    if "place" in hits.columns:
        hits, body = with_mean_in_order(hits, [*keys, "cls"], "place", ["body"]), F.first("body")
    m = hits.groupBy(*keys, "cls").agg(body.alias("body"), F.percentile("decay", num(0.5)).alias("decay"), F.count("*").alias("hits"))
    c = F.col("cls")
    sound = F.when(c == "kick", "bd").when(c == "snare", "sd").when((c == "hat") & (F.col("decay") >= CLOSED_DECAY), "hh").when((c == "hat") & F.col("decay").isNotNull(), "oh")
    offers = F.when((c == "snare") & (F.col("body") < SHELL_BODY), F.array(F.lit("cp"))).when(c == "unclassified", F.array(*[F.lit(x) for x in PALETTE])).otherwise(F.array().cast("array<string>"))
    return m.select(*keys, "cls", sound.alias("sound"), offers.alias("offers"), "hits", evidence(body=F.col("body"), decay=F.col("decay"), hits=F.col("hits")).alias("evidence"))


def bass_sound(low: Column, brightness: Column, centroid: Column, silent: Column) -> Column:
    sub = (low >= SUB[0]) & (brightness <= SUB[1]) & (centroid <= SUB[2])
    harmonic = (low <= HARMONIC[0]) & (brightness >= HARMONIC[1]) & (centroid >= HARMONIC[2])
    return F.when(~F.coalesce(silent, F.lit(False)), F.when(sub, "sine").when(harmonic, "sawtooth"))


#: Waveforms to choose from where the spectrum decides nothing.
WAVEFORMS = ["sine", "sawtooth", "square", "triangle"]


def bass_suggestion(low: Column, brightness: Column, centroid: Column, silent: Column, status: Column) -> Column:
    """struct(role, match, sound, reason, alternatives, evidence) for a bass; a silent one gets no sound whatever its spectrum."""
    quiet = F.coalesce(silent, F.lit(False))
    sound = bass_sound(low, brightness, centroid, silent)
    figures = F.format_string("low-band ratio %.2f, brightness %.3f, centroid %.0f Hz", low, brightness, centroid)
    reason = (
        F.when(quiet, F.lit("below the silence floor: the spectrum is residue, shown as evidence only"))
        .when(sound == "sine", F.concat(F.lit("energy at the fundamental: "), figures))
        .when(sound == "sawtooth", F.concat(F.lit("energy beyond the fundamental: "), figures))
        .otherwise(F.lit("the spectrum reads clearly neither as sub bass nor as rich in harmonics"))
    )
    caveat = F.when(~quiet & ~status.isin("ok", "not_attempted"), F.concat(F.lit(" (the bass line's status is "), status, F.lit("; this goes by the spectrum alone)"))).otherwise(F.lit(""))
    none = F.array().cast("array<string>")
    others = F.when(quiet | (sound == "sine"), none).when(sound == "sawtooth", F.array(F.lit("square"))).otherwise(F.array(*[F.lit(w) for w in WAVEFORMS]))
    return F.struct(
        F.lit("bass").alias("role"),
        F.when(sound.isNotNull(), "approximate").otherwise("none").alias("match"),
        sound.alias("sound"),
        F.concat(reason, caveat).alias("reason"),
        others.alias("alternatives"),
        evidence(low=low, brightness=brightness, centroid=centroid).alias("evidence"),
    )


def sounds(hits: DataFrame, bass: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, sound, alternatives, evidence): the drums' sounds and the bass's, of (keys, low, brightness, centroid, silent, status), together."""
    drums = drum_sound(hits, keys).select(*keys, F.col("cls").alias("role"), "sound", F.col("offers").alias("alternatives"), "evidence")
    b = bass.select(*keys, bass_suggestion(*[F.col(c) for c in ("low", "brightness", "centroid", "silent", "status")]).alias("_b"))
    return drums.unionByName(b.select(*keys, "_b.role", "_b.sound", "_b.alternatives", "_b.evidence"))
