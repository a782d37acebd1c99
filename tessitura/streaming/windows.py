"""Windows over an event stream. Not of the original operator set: offered besides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of a stream or table of events (ts, event_type, value)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of stretches without a pause longer than ``gap``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(spark: SparkSession, folder: str, glob: str, schema, transform, name: str, checkpoint: str) -> DataFrame:
    """Streams the files of ``folder`` that match through ``transform``, an aggregation, into a parquet table and reads it back.

    Each batch writes the whole result anew (complete mode), so windows still open at the end are in it.
    """
    path = f"{checkpoint}/{name}"
    out = transform(spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)).writeStream.outputMode("complete").option("checkpointLocation", f"{path}-log")
    q = out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path)


def run_bounded(spark: SparkSession, folder: str, glob: str, schema, checkpoint: str, late: str = "10 minutes", size: str = "1 hour", files_at_once: int = 1) -> tuple[DataFrame, DataFrame]:
    """(windows, late rows) of a stream whose state is evicted behind the watermark.

    Update mode: each batch holds the windows that it changed, written under the batch's number, so a batch that runs again writes the same
    place; the latest value of each (start, event_type) counts, and windows that are still open at the end are there. Rows whose window no
    longer takes any go to a table of their own; a batch's rows are held against the watermark that the batch before it had.
    """
    root = f"{checkpoint}/bounded"
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).parquet(folder)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/windows/part={number}")

    def keep_late(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        marks = f"{root}/marks"
        seen = session.read.schema("part int, top timestamp").parquet(marks).filter(F.col("part") < number - 1).agg(F.max("top")).first()[0] if number > 1 else None
        b = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        closed = F.date_trunc("second", F.lit(seen)) - F.expr(f"interval {late}") if seen is not None else None
        behind = F.window("ts", size)["end"] <= closed if seen is not None else F.lit(False)
        b.filter(behind).write.mode("overwrite").parquet(f"{root}/late/part={number}")
        b.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{marks}/part={number}")

    # the late rows first: both streams cut the files into the same batches
    for name, frame, write, mode in (("late", source, keep_late, "append"), ("windows", tumbling(source, late, size), upsert, "update")):
        q = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/{name}-log").foreachBatch(write).trigger(availableNow=True).start()
        q.awaitTermination()
    latest = spark.read.parquet(f"{root}/windows").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
    return latest, spark.read.schema(schema).parquet(f"{root}/late")
