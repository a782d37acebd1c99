"""From the frames of each source to one row of descriptors, with a placeholder for what is missing.

The parts are separate plans joined by (track, source); one that has nothing to say leaves nulls, which
are named in ``unavailable_features``. Only the drums' grid feeds another source (the bass).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import HOP_SECONDS, chroma_entropy, num
from tessitura.operators import rhythm, series, tonal
from tessitura.session import materialize

SOURCES = ["mix", "drums", "bass", "vocals", "other"]
BLOCKS = {
    "rhythm": ["bpm", "onset_density", "transient_sharpness"],
    "tonal": ["key", "scale", "key_confidence", "chroma_entropy", "tonal_stability"],
    "spectral": ["band_low", "band_low_mid", "band_high_mid", "band_high", "brightness", "centroid_energy_hz", "centroid_mean", "centroid_std", "rolloff_mean"],
    "dynamics": ["loudness_lufs", "peak", "crest_factor", "rms_mean", "rms_std"],
}
KEYS = ["track", "source"]


def spectral(frames: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Ratios of the shared bands, brightness, energy centroid, and means and deviations over frames, in one aggregation."""
    sums = {c: F.sum(c).alias(f"_{c}") for c in ("e_low", "e_low_mid", "e_high_mid", "e_high", "e_bright", "e_moment")}
    a = frames.groupBy(*keys).agg(*sums.values(), F.avg("centroid").alias("centroid_mean"), F.stddev_pop("centroid").alias("centroid_std"), F.avg("rolloff").alias("rolloff_mean"), F.avg("rms").alias("rms_mean"), F.stddev_pop("rms").alias("rms_std"))
    total = F.nullif(F.col("_e_low") + F.col("_e_low_mid") + F.col("_e_high_mid") + F.col("_e_high"), num(0))
    bands = [(F.col(f"_e_{b}") / total).alias(f"band_{b}") for b in ("low", "low_mid", "high_mid", "high")]
    return a.select(*keys, *bands, (F.col("_e_bright") / total).alias("brightness"), (F.col("_e_moment") / total).alias("centroid_energy_hz"), "centroid_mean", "centroid_std", "rolloff_mean", "rms_mean", "rms_std")


def tonality(frames: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean chroma, its entropy and key, and 1 less the mean cosine distance of neighbouring frames."""
    w = series.over(keys)
    d = frames.select(*keys, "frame", "chroma", F.lag("chroma").over(w).alias("_b"))
    stable = num(1) - F.avg(num(1) - series.cosine(F.col("chroma"), F.col("_b")))
    a = d.groupBy(*keys).agg(stable.alias("tonal_stability"), *[F.avg(F.get("chroma", F.lit(i))).alias(f"_c{i}") for i in range(12)])
    a = a.select(*keys, "tonal_stability", F.array(*[F.col(f"_c{i}") for i in range(12)]).alias("chroma"))
    key = tonal.estimate_key(a, keys).select(*keys, "key", "scale", F.col("confidence").alias("key_confidence"))
    return a.withColumn("chroma_entropy", chroma_entropy(F.col("chroma"))).join(key, keys, "left")


def unavailable(blocks: dict[str, list[str]], statuses: dict[str, Column] | None = None) -> Column:
    """Sorted ``block.field`` of what is null or an empty list, and ``name (status=...)`` of what was tried and failed."""
    paths = [F.when(F.col(f).isNull(), F.lit(f"{b}.{f}")) for b, fs in blocks.items() for f in fs]
    failed = [F.when(~s.isin("ok", "not_attempted"), F.concat(F.lit(f"{n} (status="), s, F.lit(")"))) for n, s in (statuses or {}).items()]
    return F.array_sort(F.filter(F.array(*paths, *failed), lambda x: x.isNotNull()))


def missing_paths(prefix: str, c: Column, kind: T.DataType) -> list[Column]:
    """For each leaf of a nested column its dotted path where it is null or an empty list, else null; structs are descended into."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in missing_paths(f"{prefix}.{f.name}", c[f.name], f.dataType)]
    empty = F.coalesce(F.size(c) == 0, F.lit(True)) if isinstance(kind, T.ArrayType) else c.isNull()
    return [F.when(empty, F.lit(prefix))]


def unavailable_in(df: DataFrame, blocks: list[str]) -> Column:
    """Sorted dotted paths of what is null or empty in the struct columns ``blocks``, at any depth."""
    paths = [x for b in blocks for x in missing_paths(b, F.col(b), df.schema[b].dataType)]
    return F.array_sort(F.array_compact(F.array(*paths)))


def analyse(frames: DataFrame, levels: DataFrame, wanted: DataFrame, hop: float = HOP_SECONDS) -> DataFrame:
    """One row for each of ``wanted`` (track, source): ``status`` ok or missing, all descriptors, what is unavailable.

    ``frames`` are rows of the sound pass, ``levels`` of whole recordings (loudness, peak, crest).
    """
    return described(materialize(frames, "sound-frames"), levels, wanted, hop)  # the pass over samples runs once


def described(frames: DataFrame, levels: DataFrame, wanted: DataFrame, hop: float = HOP_SECONDS) -> DataFrame:
    """``analyse`` of frames that are written already."""
    found = materialize(rhythm.onsets(frames, KEYS), "onsets")
    timing = rhythm.describe(frames, found, KEYS, hop)
    speed = rhythm.trusted(rhythm.coarse_tempo(frames, KEYS, hop), timing, KEYS).select(*KEYS, "bpm")
    loud = levels.select(*KEYS, F.col("lufs").alias("loudness_lufs"), "peak", F.col("crest").alias("crest_factor"))
    out = wanted.select(*KEYS)
    for part in (timing, speed, spectral(frames), tonality(frames), loud):
        out = out.join(part, KEYS, "left")
    fields = [f for fs in BLOCKS.values() for f in fs]
    status = F.when(F.col("seconds").isNull(), "missing").otherwise("ok")
    return out.select(*KEYS, status.alias("status"), "seconds", *fields, unavailable(BLOCKS).alias("unavailable_features"))


def expected(tracks: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """(track, source) of every source that a track should have."""
    return tracks.select("track").distinct().withColumn("source", F.explode(F.array(*[F.lit(s) for s in sources])))
