"""Quality rules with cross-document line frequency (operator 10). DataFrame functions only.

Base rules judge each text alone. The method then looks across documents: lines are
normalised (lower-cased, white space folded, trimmed) and hashed to 128 bits; per host
(``source``) and line the distinct documents are counted; a line above the host's limit is
removed; a document that loses more than ``max_lost`` of its words this way is depleted and
rejected. ``keep`` returns the others without these lines.

A document counts once for each different whole text of its host, in a line's count as in the host's, so
exact copies neither turn the content they share into boilerplate nor hide that of others. Documents that
differ in anything count one by one.

Defined cases: a null or empty text has no words, so it fails the base rules; null hosts form
one host; repeated rows are judged alike, each keeps its row; a null ``doc_id`` is an id like
any other; an empty table gives no rows; other columns pass through untouched in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import NON_SPACE, folded, null_safe, text_or_empty, without_lines, words
from tessitura.session import discard, materialize


@dataclass(frozen=True)
class LineLimits:
    """A line is above the limit in more than ``min_docs`` different documents and more than ``share`` of its host's."""

    min_docs: int = 20
    share: float = 0.02
    max_lost_percent: int = 70


#: Fixed by the contract.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Repeated windows of a text that are looked up one by one; more are found by sorting.
LOOKED_UP = 64
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _at(a: Column, i: Column) -> Column:
    """Element or null, also beyond the ends."""
    return F.get(a, i)


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text_or_empty(text), "\n"), lambda x: x.rlike(NON_SPACE))


def _repeated(s: Column) -> Column:
    """The values that stand side by side in the sorted array ``s``."""
    return F.array_distinct(F.filter(s, lambda x, i: x == _at(s, i + 1)))


def _with_places(df: DataFrame) -> DataFrame:
    """Adds ``_p``, where ``_h`` holds one of the values ``_d``, in order; many values are found by sorting the windows with their places."""
    by_sorting = F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.withColumn("_t", F.when(F.size("_d") > LOOKED_UP, by_sorting))  # a column, so that it is sorted once
    t = F.col("_t")
    twice = F.filter(t, lambda x, i: (_at(t, i - 1)["h"] == x["h"]) | (_at(t, i + 1)["h"] == x["h"]))
    by_looking = F.array_compact(F.transform("_h", lambda x, i: F.when(F.array_contains("_d", x), i)))
    return df.withColumn("_p", F.when(t.isNotNull(), F.array_sort(F.transform(twice, lambda x: x["p"]))).when(F.col("_s").isNotNull(), by_looking))


def base_stats(docs: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns and the base figures of every row's whole text."""
    text = text_or_empty(F.col("text"))
    lines = worded_lines(F.col("text"))
    out = docs.select(
        *key,
        words(F.col("text")).alias("_w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    n, w = F.size("_w"), F.col("_w")
    # columns, not expressions: each is used more than once below
    out = out.select(
        *key,
        "n_symbols",
        "n_dup_lines",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.when(n >= 3, F.transform(F.slice(w, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, _at(w, i + 1), _at(w, i + 2)))).alias("_h"),
    )
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))  # null: all windows differ
    out = out.withColumn("_d", _repeated(F.col("_s")))
    out = _with_places(out).drop("_h", "_s", "_d", "_t")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-10).alias("last"), F.lit(0).cast("long").alias("c")),
        lambda a, p: F.struct(p.alias("last"), (a["c"] + F.least(F.lit(3), p - a["last"])).alias("c")),
        lambda a: a["c"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lines(docs: DataFrame, key: list[str]) -> DataFrame:
    """A row for each worded line of each document: its place, hash and words."""
    rows = docs.select(*key, F.split(text_or_empty(F.col("text")), "\n").alias("_l"))
    rows = rows.select(*key, F.posexplode(F.transform("_l", lambda x: F.when(x.rlike(NON_SPACE), folded(x)))).alias("pos", "_x")).filter("_x is not null")
    spaces = F.length("_x") - F.length(F.replace("_x", F.lit(" "), F.lit("")))
    return rows.select(*key, "pos", F.xxhash64("_x").alias("line_a"), F.xxhash64(F.lit(1), "_x").alias("line_b"), (spaces + 1).alias("line_words"))


LINE = ["line_a", "line_b"]


def _frequent(lines: DataFrame, docs: DataFrame, limits: LineLimits) -> DataFrame:
    """Lines above their host's limit; ``docs`` has a row (host, text_key) for each document."""
    counts = lines.select("host", *LINE, "text_key").distinct().groupBy("host", *LINE).agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limits.min_docs)
    hosts = docs.select(F.col("host").alias("_host"), "text_key").distinct().groupBy("_host").agg(F.count("*").alias("host_docs"))
    joined = counts.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return joined.filter(F.col("n_docs") > limits.share * F.col("host_docs")).select("host", *LINE, "n_docs")


KEY = ["doc_id", "host", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("host"), F.unhex(F.md5(text_or_empty(F.col("text")))).alias("text_key"), "text")


def frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(host, line_a, line_b, n_docs) of the lines above their host's limit."""
    docs = _keyed(docs)
    return _frequent(_lines(docs, ["host", "text_key"]), docs, limits)


def _judged(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """Per row of ``docs`` its key, the base figures, ``n_lost_words``, the places of the lines removed and ``kept``."""
    docs = _keyed(docs)
    lines = materialize(_lines(docs, KEY), "quality-lines")
    # written first: a filter pushed into the lambdas would sort the windows anew for each of them
    base = materialize(base_stats(docs, KEY), "base-figures")
    flagged = _frequent(lines, base, limits).select(F.col("host").alias("_host"), F.col("line_a").alias("_a"), F.col("line_b").alias("_b"))
    hit = lines.join(flagged, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line_a") == F.col("_a")) & (F.col("line_b") == F.col("_b"))).select(*KEY, "pos", "line_words")
    # rows that repeat bring each place more than once; it counts once
    lost = hit.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("pos", "line_words"))).alias("_x"))
    lost = lost.select(*KEY, F.aggregate("_x", F.lit(0).cast("long"), lambda a, x: a + x["line_words"]).alias("n_lost_words"), F.col("_x.pos").alias("removed"))
    lost = materialize(lost, "lost-lines")
    discard(lines)
    out = base.join(lost, null_safe(base, lost, KEY), "left").select(*[base[k] for k in KEY], *BASE, F.coalesce("n_lost_words", F.lit(0).cast("long")).alias("n_lost_words"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_lost_words") <= limits.max_lost_percent * F.col("n_words")))


def judge(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): the base figures, ``n_lost_words`` and ``kept``."""
    return _judged(docs, limits).drop("removed")


def keep(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, with all their columns, their texts without the lines above limits."""
    good = _judged(docs, limits).filter("kept").select(*[F.col(k).alias(f"_kept_{k}") for k in KEY], F.col("removed").alias("_kept_removed")).dropDuplicates([f"_kept_{k}" for k in KEY])
    name = F.unhex(F.md5(text_or_empty(docs["text"])))
    same = docs["doc_id"].eqNullSafe(good["_kept_doc_id"]) & docs["source"].eqNullSafe(good["_kept_host"]) & (name == good["_kept_text_key"])
    joined = docs.join(good, same).select(*[docs[c] for c in docs.columns], "_kept_removed")
    text = without_lines(F.col("text"), F.split("text", "\n"), F.col("_kept_removed"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return judge(table(spark, sf_dir, "documents")).select("doc_id", *BASE[:5], "base_failed", "kept")


def oracle(limits: LineLimits = LineLimits()) -> str:
    ws = r"[\x20\x09-\x0D]+"
    return rf"""
with d as (select row_number() over () r, doc_id, source host, coalesce(text, '') t from documents),
w as (select r, list_filter(string_split_regex(t, '{ws}'), lambda x: x <> '') w from d),
tri as (select r, unnest(range(1, len(w) - 1)) p, w from w where len(w) >= 3),
t2 as (select r, p, count(*) over (partition by r, w[p], w[p + 1], w[p + 2]) c from tri),
rep as (select r, count(distinct q) n from (select r, unnest([p, p + 1, p + 2]) q from t2 where c > 1) group by r),
ln as (select r, host, unnest(string_split(t, chr(10))) l from d),
lw as (select r, host, l, trim(regexp_replace(lower(l), '{ws}', ' ', 'g')) x from ln where regexp_matches(l, '[^\x20\x09-\x0D]')),
lc as (select *, len(string_split(x, ' ')) n from lw),
cnt as (select lc.host, x, count(distinct t) c from lc join d using (r) group by lc.host, x having count(distinct t) > {limits.min_docs}),
hosts as (select host, count(distinct t) n from d group by all),
flag as (select cnt.host, x from cnt join hosts on cnt.host is not distinct from hosts.host where c > {limits.share}::double * n),
lost as (select r, sum(n) n from lc join flag on lc.host is not distinct from flag.host and lc.x = flag.x group by r),
dup as (select r, count(*) - count(distinct l) n from lc group by r),
b as (select d.r, doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines,
  coalesce(rep.n, 0) n_repeat_words, coalesce(lost.n, 0) lost
  from d join w on d.r = w.r left join rep on d.r = rep.r left join dup on d.r = dup.r left join lost on d.r = lost.r)
select doc_id, n_words::bigint n_words, coalesce(word_chars, 0)::bigint word_chars, n_symbols::bigint n_symbols,
  n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= {limits.max_lost_percent} * n_words kept from b
"""
