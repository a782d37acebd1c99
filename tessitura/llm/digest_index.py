"""Exact deduplication against a persistent digest index (operator 13).

The index is a Parquet table of (digest, doc_id, batch), bucketed and sorted by digest, at a path
that outlives the session. A batch of documents is reduced to digests of its normalised texts,
pre-aggregated to one row for each digest, dealt to the index's buckets and anti-joined with it by
sort-merge; the index side is neither shuffled nor read as a whole by any task. What is left is new and is
appended. The first batch that brings a text keeps it; inside a batch the smallest doc_id does.

Adding a batch again appends nothing, so a job that was lost half-way is simply run again.

Defined cases: a null text counts as empty, and empty texts are equal; of equal texts the smallest
doc_id stays, null last; of rows that repeat id and text one stays; an empty table adds nothing; other
columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import SPACES, text_or_empty
from tessitura.session import discard, materialize, new_path

#: Orders null ids last.
LAST = (1 << 63) - 1


def digest(text: Column) -> Column:
    """Hex sha256 of the text with every stretch of white space as one space."""
    return F.sha2(F.regexp_replace(text_or_empty(text), SPACES, " "), 256)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): the only pass over the texts; ``row`` tells rows that repeat apart."""
    rows = docs.select("doc_id", F.unhex(digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows, "digests")


def firsts(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, row, n): of each digest the first row and the number of rows, summed before the shuffle."""
    order = F.coalesce("doc_id", F.lit(LAST))
    return rows.groupBy("digest").agg(F.min_by("doc_id", order).alias("doc_id"), F.min_by("row", order).alias("row"), F.count("*").alias("n"))


@dataclass(frozen=True)
class DigestIndex:
    """An index at ``path``; the bucket number is fixed when the index is made and must be named alike later."""

    spark: SparkSession
    path: str
    buckets: int

    @property
    def name(self) -> str:
        return "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()

    def open(self) -> DigestIndex:
        """Makes the index known to this session, over the files that are at its path, if any."""
        self.spark.sql(
            f"create table if not exists {self.name} (digest binary, doc_id bigint, batch string) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'"
        )
        return self

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, fresh: DataFrame) -> DataFrame:
        """Those rows of ``fresh`` (digest, doc_id), one for each digest, that the index doesn't hold, dealt to its buckets."""
        held = self.entries().select(F.col("digest").alias("_held")).hint("merge")
        return fresh.repartition(self.buckets, "digest").join(held, F.col("digest") == F.col("_held"), "left_anti")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the digests of ``rows`` (of ``fingerprints``) that the index doesn't hold."""
        # written first, or the anti-join is moved below the aggregation and a text's copies meet in its bucket
        fresh = materialize(firsts(rows).select("digest", "doc_id"), "fresh-digests")
        self.unknown(fresh).select("digest", "doc_id", F.lit(batch).alias("batch")).write.insertInto(self.name)
        discard(fresh)

    def verdicts(self, rows: DataFrame, batches: list[str]) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``rows``, which were added as ``batches``.

        A row is kept if it is the first of its text here and its text is new with these batches.
        """
        held = self.entries().select(F.col("digest").alias("_held"), F.col("doc_id").alias("keep_id"), "batch")
        seen = firsts(rows).select(F.col("digest").alias("_digest"), F.col("row").alias("_row"), F.col("n").alias("group_size"))
        # written, so that the last join has two plain shuffles, of which a hot digest's rows can be split
        seen = materialize(seen.repartition(self.buckets, "_digest").join(held.hint("merge"), F.col("_digest") == F.col("_held")), "digest-entries")
        out = rows.join(seen, F.col("digest") == F.col("_digest"))
        kept = (F.col("row") == F.col("_row")) & F.col("batch").isin(batches)
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, path: str) -> DigestIndex:
        """The same index at ``path`` with one sorted file for each bucket, after many appends."""
        out = DigestIndex(self.spark, path, self.buckets).open()
        self.entries().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(out.name)
        return out


def add_new(index: DigestIndex, docs: DataFrame, batch: str) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the index did not hold, one for each text; their digests are appended."""
    rows = fingerprints(docs)
    index.add(rows, batch)
    discard(rows)
    own, held_id, held = (_free(docs, c) for c in ("_own_digest", "_held_id", "_held_digest"))
    new = index.entries().filter(F.col("batch") == batch).select(F.col("digest").alias(held), F.col("doc_id").alias(held_id))
    named = docs.withColumn(own, F.unhex(digest(docs["text"])))
    first = named.join(new, (F.col(own) == F.col(held)) & docs["doc_id"].eqNullSafe(F.col(held_id)))
    return first.dropDuplicates([own]).select(*docs.columns)


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def by_age(rows: DataFrame) -> list[tuple[str, DataFrame]]:
    """Two batches by rising id, so that the first to come is the smallest: up to the middle id, and the rest with null ids."""
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    if middle is None:
        return [("all", rows)]
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return [("backlog", rows.filter(old)), ("increment", rows.filter(~old))]


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    rows = fingerprints(table(spark, sf_dir, "documents"))
    index = DigestIndex(spark, new_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions"))).open()
    batches = by_age(rows)
    for name, part in batches:
        index.add(part, name)
    return index.verdicts(rows, [name for name, _ in batches])


def oracle() -> str:
    return r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) h from documents)
select doc_id, min(doc_id) over (partition by h) keep_id, count(*) over (partition by h) group_size,
  row_number() over (partition by h order by doc_id nulls last) = 1 kept, h text_sha256 from d
"""
