"""Documents out: rounding by schema, lists to counts, canonical JSON, layout, environment report."""

from __future__ import annotations

import importlib.util
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.functions.scalars import slugify
from tessitura.session import materialize

DIGITS = 6


def rounded(c: Column, kind: T.DataType, digits: int = DIGITS) -> Column:
    """The column with every float in it rounded, at any depth; keys and order stay."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.bround(c, digits)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[rounded(c[f.name], f.dataType, digits).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rounded(x, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: rounded(v, kind.valueType, digits))
    return c


def round_floats(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[rounded(F.col(f.name), f.dataType, digits).alias(f.name) for f in df.schema])


def counted(c: Column, kind: T.StructType, lists: set[str]) -> Column:
    """A struct with the named lists replaced by their sizes, in their places."""
    return F.struct(*[(F.size(c[f.name]) if f.name in lists else c[f.name]).alias(f.name) for f in kind])


def documents(df: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls kept, in the order of the columns."""
    return round_floats(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON documents under <path>/<key>=.../; one directory for each track and source."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in keys]), {"ignoreNullFields": "false"})
    round_floats(df).select(*keys, body.alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents with a declared schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def doctor(spark: SparkSession) -> DataFrame:
    """(probe, found, detail) of the environment; never raises."""
    rows = [("python", True, sys.version.split()[0]), ("spark", True, spark.version)]
    for m in ("numpy", "pandas", "pyarrow", "scipy", "soundfile", "librosa", "essentia", "torch", "demucs"):
        there = importlib.util.find_spec(m) is not None
        rows.append((m, there, "" if there else "absent: WAV only, own estimators, no separation"))
    return spark.createDataFrame(rows, "probe string, found boolean, detail string")


def doctor_of(inputs: dict, spark: SparkSession) -> DataFrame:
    """(probe, found, detail) of inputs by name, each made by a function: its number of rows, or why it can't be read."""
    out = None
    for name, make in inputs.items():
        try:
            one = make().agg(F.lit(name).alias("probe"), F.lit(True).alias("found"), F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("detail"))
        except Exception as e:  # noqa: BLE001 - a report of what is wrong must not fail on it
            one = spark.createDataFrame([(name, False, f"{type(e).__name__}: {str(e).splitlines()[0]}")], "probe string, found boolean, detail string")
        out = one if out is None else out.unionAll(one)
    return out


def document_path(root: str, track: Column, source: Column) -> Column:
    """Where a source's document belongs: <root>/<slug>/analysis/<source>.json, the track's own at <root>/<slug>/track_summary.json."""
    folder = F.concat(F.lit(root.rstrip("/") + "/"), slugify(track))
    return F.when(source.isNull(), F.concat(folder, F.lit("/track_summary.json"))).otherwise(F.concat(folder, F.lit("/analysis/"), source, F.lit(".json")))


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Writes one JSON file for each row (track, source, other columns; source null for the track's own) at its path; (track, source, path).

    Each task opens its own files through the file system of ``root``; a task that runs again writes the same bytes.
    """
    from pyarrow import RecordBatch, array, fs, string

    body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in ("track", "source")]), {"ignoreNullFields": "false"})
    rows = round_floats(df).select("track", "source", document_path(root, F.col("track"), F.col("source")).alias("path"), body.alias("value"))

    def run(batches):
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(path)
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(value.encode())
            yield RecordBatch.from_arrays([array(batch.column(c).to_pylist(), string()) for c in ("track", "source", "path")], names=["track", "source", "path"])

    return materialize(rows.mapInArrow(run, "track string, source string, path string"), "written")
