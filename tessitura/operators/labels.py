"""Graded labels with evidence from one wide row of descriptors for each (track, source).

A rule is a label, the sources it holds for and ramps over descriptors; its confidence is the
least of its ramps. A silent source gets the silence label alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.scalars import every, evidence, finite, num, r6, ramp


@dataclass(frozen=True)
class Rule:
    label: str
    source: str  # "any" for all
    ramps: tuple[tuple[str, float, float], ...]  # descriptor, threshold, saturation


#: Fixed values.
SILENCE_LUFS, SILENCE_RMS = (-50.0, -70.0), (0.003, 0.0)
RULES = [
    Rule("percussive", "any", (("crest_factor", 8.0, 20.0), ("onset_density", 2.0, 6.0))),
    Rule("sustained", "any", (("crest_factor", 4.0, 1.6), ("onset_density", 2.0, 0.25))),
    Rule("noisy", "any", (("centroid_energy_hz", 2500.0, 8000.0), ("chroma_entropy", 0.93, 1.0))),
    Rule("tonally stable", "any", (("chroma_entropy", 0.80, 0.0),)),
    Rule("busy drums", "drums", (("onset_density", 5.0, 12.0),)),
    Rule("sparse percussion", "drums", (("onset_density", 1.0, 0.0),)),
    Rule("kick-heavy", "drums", (("band_low", 0.5, 0.85),)),
    Rule("bright hats", "drums", (("band_high", 0.12, 0.35), ("centroid_mean", 1000.0, 6000.0))),
    Rule("sparse bass", "bass", (("onset_density", 1.0, 0.0),)),
    Rule("sustained sub", "bass", (("centroid_energy_hz", 250.0, 60.0), ("onset_density", 2.0, 0.25))),
    Rule("plucked bass", "bass", (("transient_sharpness", 3.0, 8.0),)),
    Rule("speech/vocal dominant", "vocals", (("rms_mean", 0.01, 0.1), ("centroid_energy_hz", 300.0, 700.0), ("centroid_energy_hz", 3000.0, 2600.0), ("onset_density", 1.0, 2.0), ("onset_density", 5.0, 4.0))),
    Rule("sparse vocal", "vocals", (("onset_density", 1.0, 0.0),)),
    Rule("processed/wide vocal", "vocals", (("band_high", 0.04, 0.2), ("centroid_std", 800.0, 2000.0))),
    Rule("sustained pad-like texture", "other", (("crest_factor", 4.0, 1.6), ("onset_density", 2.0, 0.25))),
    Rule("noisy", "other", (("centroid_energy_hz", 2500.0, 8000.0), ("chroma_entropy", 0.93, 1.0))),
    Rule("bright plucks", "other", (("band_high", 0.25, 0.9), ("centroid_mean", 1000.0, 6000.0), ("transient_sharpness", 3.0, 8.0))),
]
DESCRIPTORS = ["loudness_lufs", "rms_mean", "crest_factor", "onset_density", "centroid_energy_hz", "centroid_mean", "centroid_std", "chroma_entropy", "band_low", "band_high", "transient_sharpness"]


def silence() -> Column:
    """Confidence that a source is silent: by loudness, or by level where there is no loudness."""
    return F.when(F.col("loudness_lufs").isNotNull(), ramp(F.col("loudness_lufs"), *SILENCE_LUFS)).otherwise(ramp(F.col("rms_mean"), *SILENCE_RMS))


def label(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, confidence, evidence): one row for each label; of equal names the most confident."""
    rows = []
    for r in RULES:
        confidence = every(*[ramp(F.col(d), t, s) for d, t, s in r.ramps])
        holds = F.lit(True) if r.source == "any" else F.coalesce(F.col("source") == r.source, F.lit(False))
        seen = evidence(**{d: F.col(d) for d in sorted({d for d, _, _ in r.ramps})})
        rows.append(F.when(holds & F.col("_silent").isNull() & confidence.isNotNull(), F.struct(F.lit(r.label).alias("label"), confidence.alias("confidence"), seen.alias("evidence"))))
    gate = F.when(F.col("_silent").isNotNull(), F.struct(F.lit("silent/absent stem").alias("label"), F.col("_silent").alias("confidence"), evidence(loudness_lufs=F.col("loudness_lufs"), rms_mean=F.col("rms_mean")).alias("evidence")))
    df = df.withColumn("_silent", silence()).withColumn("_r", F.filter(F.array(gate, *rows), lambda x: x.isNotNull()))
    out = df.select(*keys, F.inline("_r"))
    return out.groupBy(*keys, "label").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", "confidence").alias("evidence"))


RULE_ROW = "label string, source string, descriptor string, threshold double, saturation double"


def rule_rows(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """Rules as rows of RULE_ROW, one for each ramp: a table that users may add to."""
    return spark.createDataFrame([(r.label, r.source, d, t, s) for r in rules for d, t, s in r.ramps], RULE_ROW)


def label_by(df: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``label`` with the rules of a table: descriptors, one a row, meet the ramps that read them, and a label's ramps are folded.

    A rule holds where all its ramps do; a ramp over a descriptor that ``df`` lacks never does. The gate of silence comes first.
    """
    names = [c for c in df.columns if c not in keys]
    wide = df.withColumn("_silent", silence())
    long = wide.filter("_silent is null").select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("descriptor"), F.col(c).cast("double").alias("value")) for c in names if c in dict(df.dtypes) and dict(df.dtypes)[c] in ("double", "float", "int", "bigint")])))
    own = {k: f"_{k}" for k in ("label", "source", "descriptor")}
    r = rules.withColumnsRenamed(own).withColumn("_ramps", F.count("*").over(Window.partitionBy("_label", "_source")))
    hit = long.join(r, (F.col("descriptor") == F.col("_descriptor")) & ((F.col("_source") == "any") | (F.col("_source") == F.col("source"))))
    at = (F.col("value") - F.col("threshold")) / (F.col("saturation") - F.col("threshold"))
    hit = hit.withColumn("_c", F.when(finite(F.col("value")) & (at >= 0), F.least(num(1), at)))
    each = hit.groupBy(*keys, "_label", "_source").agg(F.min("_c").alias("confidence"), F.count("_c").alias("_held"), F.first("_ramps").alias("_ramps"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct("descriptor", "value")))).alias("evidence"))
    each = each.filter("_held = _ramps").select(*keys, F.col("_label").alias("label"), "confidence", "evidence")
    quiet = wide.filter("_silent is not null").select(*keys, F.lit("silent/absent stem").alias("label"), F.col("_silent").alias("confidence"), evidence(loudness_lufs=F.col("loudness_lufs"), rms_mean=F.col("rms_mean")).alias("evidence"))
    return each.unionByName(quiet).groupBy(*keys, "label").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", "confidence").alias("evidence"))


def ordered(labels: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its labels from the most confident on, ties by name."""
    item = F.struct((-F.col("confidence")).alias("c"), "label")
    return labels.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l")).select(*keys, F.transform("_l", lambda x: F.concat(x["label"], F.lit("="), r6(-x["c"]).cast("string"))).alias("labels"))


def evidence_text(seen: Column) -> Column:
    """Evidence as ``descriptor=value`` by name, four decimals."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(seen)), lambda e: F.concat(e["key"], F.lit("="), F.bround(e["value"], 4).cast("decimal(18,4)").cast("string"))), " ")


def oracle(src: str, keys: str) -> str:
    """DuckDB SQL of ``label``, its evidence as ``evidence_text`` gives it."""

    def sql_ramp(d, t, s):
        at = f"(({d} - {t}::double) / {s - t}::double)"
        return f"case when {at} >= 0 then least(1::double, {at}) end"

    def seen(names):
        return "concat_ws(' ', " + ", ".join(f"'{n}=' || round_even({n}, 4)::decimal(18,4)::varchar" for n in sorted(names)) + ")"

    gate = f"case when loudness_lufs is not null then {sql_ramp('loudness_lufs', *SILENCE_LUFS)} else {sql_ramp('rms_mean', *SILENCE_RMS)} end"
    parts = [f"select {keys}, 'silent/absent stem' as label, silent as confidence, {seen(['loudness_lufs', 'rms_mean'])} evidence from s where silent is not null"]
    for r in RULES:
        ramps = [sql_ramp(*x) for x in r.ramps]
        known = " and ".join(f"{x} is not null" for x in ramps)
        where = "true" if r.source == "any" else f"source = '{r.source}'"
        parts.append(f"select {keys}, '{r.label}' as label, least({', '.join(ramps)}) as confidence, {seen({d for d, _, _ in r.ramps})} evidence from s where silent is null and {where} and {known}")
    return f"with s as (select *, {gate} silent from ({src})) select {keys}, label, round_even(max(confidence), 6) + 0::double confidence, arg_max(evidence, confidence) evidence from ({' union all '.join(parts)}) group by {keys}, label"
