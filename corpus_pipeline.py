"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes what its predecessor kept, as rows of ``documents``; only the last returns
places instead: (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each appearance
of each document in the mix.

Every stage takes null, empty, very long and repeated texts, null ids and hosts, empty tables and
further columns, whatever their names; what becomes of them is said at the stage and in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from tessitura.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the cross-document line frequencies keep, without the lines above limits.

    ``n_chars`` is that of the text that is left. Null or short texts go; repeated rows stay or go together.
    """
    kept = quality_rules.keep(docs)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the smallest id (null last, then the text's hash).

    Rows that repeat id and text are one; rows without words stay, each of them.
    """
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever their id; without items, all rows."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's weight asks for, once at least; null is a source of its own."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; null ids and repeated rows have places of their own."""
    return sharding.shard_rows(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The latent search can't be said in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
