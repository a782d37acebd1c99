"""Mixing sources to target weights (operator 1). DataFrame functions only.

A source of token share p gets weight p^a / sum p^a. The exponent a is bisected twice: to the
largest a whose weights reach ``target_entropy`` (as a share of the greatest entropy there
is), and to the smallest a under which no source repeats more than ``max_repeat`` times; the
larger of the two holds, so the repetition limit prevails. The budget is ``budget`` tokens
or, by default, the least under which every source is used at least once, so that no document
is lost.

Weights are realised as budgeted blocks: each source's epochs are permutations of its
documents by a hash, laid end to end up to its quota; the stream is cut into blocks of about
``block_tokens`` tokens that take from every source in proportion to its weight; inside a
block documents stand in hash order. Offsets come from sums per hash bucket and sums inside
buckets, so no task holds a source.

Only the list of sources (name and tokens of each) is brought together in one row; it is as
long as there are sources, whatever the corpus.

Defined cases: a null source is a source of its own; a text without words costs nothing and
appears once; a source without words has weight 0; repeated rows appear each; an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import text_or_empty, words
from tessitura.session import materialize

STEPS = 60
BUCKET_BITS = 12


@dataclass(frozen=True)
class MixTarget:
    target_entropy: float = 0.97
    max_repeat: float = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 16
    seed: int = 17


def _sum(array: str, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))


def _bisect(holds_at_low: bool, holds) -> Column:
    """The last exponent in [0, 1] for which ``holds``, seen from the end where it does."""

    def step(a, _):
        mid = (a["lo"] + a["hi"]) / 2
        ok = holds(mid) if holds_at_low else ~holds(mid)
        return F.struct(F.when(ok, mid).otherwise(a["lo"]).alias("lo"), F.when(ok, a["hi"]).otherwise(mid).alias("hi"))

    end = lambda a: a["lo"] if holds_at_low else a["hi"]
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, end)


def source_weights(counts: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """(source, tokens, exponent, weight, budget, quota, repeat) from (source, tokens)."""
    one = counts.agg(F.array_sort(F.collect_list(F.struct("source", "tokens"))).alias("_s"))
    one = one.withColumn("_total", F.aggregate("_s", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    one = one.withColumn("_p", F.transform(F.filter("_s", lambda x: x["tokens"] > 0), lambda x: x["tokens"] / F.col("_total")))
    one = one.withColumn("_most", F.array_max("_p")).withColumn("_least", F.array_min("_p")).withColumn("_n", F.size("_p"))

    def z(a):
        return _sum("_p", lambda p: F.pow(p, a))

    def entropy(a):  # ln z - a / z * sum p^a ln p
        both = F.aggregate("_p", F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("s")), lambda x, p: F.struct((x["z"] + F.pow(p, a)).alias("z"), (x["s"] + F.pow(p, a) * F.log(p)).alias("s")), lambda x: F.log(x["z"]) - a * x["s"] / x["z"])
        return both

    def budget(a):
        return F.lit(float(target.budget)) if target.budget is not None else F.col("_total") * z(a) * F.pow("_most", F.lit(1.0) - a)

    def repeat(a):  # of the smallest source
        return budget(a) / F.col("_total") * F.pow("_least", a - F.lit(1.0)) / z(a)

    want = F.lit(target.target_entropy) * F.log(F.col("_n").cast("double"))
    by_entropy = F.when(entropy(F.lit(1.0)) >= want, F.lit(1.0)).otherwise(_bisect(True, lambda a: entropy(a) >= want))
    by_repeat = F.when(repeat(F.lit(0.0)) <= target.max_repeat, F.lit(0.0)).otherwise(_bisect(False, lambda a: repeat(a) <= target.max_repeat))
    one = one.withColumn("exponent", F.when(F.col("_n") > 0, F.greatest(by_entropy, by_repeat)).otherwise(F.lit(1.0)))
    one = one.withColumn("_z", z(F.col("exponent"))).withColumn("budget", F.coalesce(budget(F.col("exponent")), F.lit(0.0)))
    out = one.select("exponent", "_z", "_total", "budget", F.inline("_s"))
    out = out.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("_total"), F.col("exponent")) / F.col("_z")).otherwise(F.lit(0.0)))
    quota = F.round(F.col("weight") * F.col("budget")).cast("long")
    if target.budget is None:
        quota = F.greatest(quota, F.col("tokens"))
    out = out.withColumn("quota", quota)
    return out.select("source", "tokens", "exponent", "weight", "budget", "quota", F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(F.lit(0.0)).alias("repeat"))


def plan(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """A row for each appearance of each row of ``docs`` in the mixed stream.

    (doc_id, source, text_key, n_tokens, epoch, block, position): ``position`` counts from 0
    in each block.
    """
    slim = docs.select("doc_id", "source", F.xxhash64(text_or_empty(F.col("text"))).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    slim = materialize(slim, "mix-tokens")
    counts = slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    weights = source_weights(counts, target).withColumnRenamed("source", "_source")
    weights = weights.withColumn("_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("budget") / target.block_tokens)))
    epochs = F.greatest(F.lit(1).cast("long"), F.when(F.col("tokens") > 0, F.ceil(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1).cast("long")))
    rows = slim.join(weights, slim["source"].eqNullSafe(weights["_source"])).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    rows = rows.filter((F.col("n_tokens") > 0) | (F.col("epoch") == 0))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text_key", "epoch", F.lit(target.seed)))
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_h", 64 - BUCKET_BITS))
    rows = rows.select("doc_id", "source", "text_key", "n_tokens", "epoch", "tokens", "quota", "_blocks", "_h", "_bucket")
    sums = rows.groupBy("source", "epoch", "_bucket").agg(F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy("source", "epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "epoch", "_bucket").orderBy("_h", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_s"]) & (rows["epoch"] == starts["_e"]) & (rows["_bucket"] == starts["_b"]))
    rows = rows.withColumn("_at", F.col("epoch") * F.col("tokens") + F.col("_start") + F.col("_in"))
    rows = rows.filter((F.col("_at") < F.col("quota")) | (F.col("n_tokens") == 0))
    spread = F.when(F.col("quota") > 0, F.floor(F.col("_at") * (F.col("_blocks") / F.col("quota")))).otherwise(F.pmod("_h", "_blocks"))
    rows = rows.withColumn("block", F.least(F.col("_blocks") - 1, spread).cast("long"))
    order = Window.partitionBy("block").orderBy(F.xxhash64("_h", "block"), "doc_id", "text_key", "epoch")
    return rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")).select("doc_id", "source", "text_key", "n_tokens", "epoch", "block", "position")


def mix(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """The rows of ``docs``, each as often as the plan lets it appear.

    Rows equal in id, source and text share their appearances, rounded up.
    """
    keyed = docs.withColumn("_key", F.xxhash64(text_or_empty(docs["text"])))
    shown = plan(docs, target).groupBy("doc_id", "source", "text_key").agg(F.count("*").alias("_n"), F.count(F.when(F.col("epoch") == 0, 1)).alias("_rows"))
    shown = shown.withColumn("_times", F.ceil(F.col("_n") / F.greatest(F.col("_rows"), F.lit(1))).cast("int")).select(F.col("doc_id").alias("_id"), F.col("source").alias("_s"), "text_key", "_times")
    on = keyed["doc_id"].eqNullSafe(shown["_id"]) & keyed["source"].eqNullSafe(shown["_s"]) & (keyed["_key"] == shown["text_key"])
    return keyed.join(shown, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[keyed[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return plan(table(spark, sf_dir, "documents")).drop("text_key")
