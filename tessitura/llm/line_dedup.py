"""Line dedup by a deletion-neighbourhood join (operator 8). DataFrame functions only.

Lines are normalised (lower-cased, white space folded). A line goes if an earlier line of
the corpus, by (doc_id, text hash, line number), is equal or near. Near is an edit distance of one
token, where a fifth of the tokens may differ: tokens are words in lines of ``TOKENS`` words or
more, characters in shorter lines of ``TOKENS`` characters or more (lines of the two kinds are not near
each other). Lines without a word always stay.

1. Distinct lines keep their first place only.
2. Two lines one edit apart share their beginning or their end, of any length up to half of
   theirs. Lines that share neither with another distinct line are done; this is counted, no
   lines are brought together. Lengths are rounded down to few values, so a line has two such
   keys, and four where its length begins a new value.
3. The others are fetched from their texts and emit their deletion variants: the line without
   its i-th token, and the line itself, as 64-bit keys. Equal (variant, i) means one substitution, a
   variant equal to a whole line means one deletion; either way each member needs only the
   earliest of its group, so an aggregate answers all, and no pairs are formed.
4. The edit distance to that earliest line is verified on the tokens.

Defined cases: a null text has no lines; a null ``doc_id`` comes last, ids of any type that has an order;
texts under one id are told apart by their hash; rows that repeat id and text stand at the same
place and are cut alike; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import NON_SPACE, folded, null_safe, text_or_empty, without_lines
from tessitura.session import materialize

TOKENS = 5
ID = ["doc_id", "text_key"]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(text_or_empty(F.col("text")))).alias("text_key"), "text")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), *ID, "pos")


def tokens(norm: Column, words: Column) -> Column:
    return F.when(F.size(words) >= TOKENS, words).otherwise(F.split(norm, ""))


def _shared(m: Column) -> Column:
    """How many tokens at either end two lines of about m tokens compare: just under half, with three binary digits."""
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(m)).cast("int") - 3, F.lit(0)))
    return (F.floor(F.floor((m - 1) / 2) / step) * step).cast("int")


def _ends(t: Column, m: Column, size: Column, kind: Column) -> list[Column]:
    return [F.xxhash64(F.lit("first"), kind, size, F.slice(t, F.lit(1), size)), F.xxhash64(F.lit("last"), kind, size, F.slice(t, m - size + 1, size))]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, key, ends) of every line with a word; ``ends`` are the keys that near lines share, null for lines that are near none."""
    rows = docs.select(*ID, F.posexplode(F.split(text_or_empty(F.col("text")), "\n")).alias("pos", "_l")).filter(F.col("_l").rlike(NON_SPACE))
    rows = rows.select(*ID, "pos", folded(F.col("_l")).alias("norm"))
    # columns, not expressions: each is used many times below and worth computing once
    rows = rows.select(*ID, "pos", "norm", F.split("norm", " ").alias("_w"))
    rows = rows.select(*ID, "pos", F.unhex(F.md5("norm")).alias("key"), (F.size("_w") >= TOKENS).alias("_k"), tokens(F.col("norm"), F.col("_w")).alias("_t"))
    rows = rows.select(*ID, "pos", "key", "_k", "_t", F.size("_t").alias("_m"))
    rows = rows.select(*ID, "pos", "key", "_k", "_t", "_m", _shared(F.col("_m")).alias("_p"), _shared(F.col("_m") - 1).alias("_q"))
    own = _ends(F.col("_t"), F.col("_m"), F.col("_p"), F.col("_k"))
    more = [F.when(F.col("_p") != F.col("_q"), x) for x in _ends(F.col("_t"), F.col("_m"), F.col("_q"), F.col("_k"))]
    return rows.select(*ID, "pos", "key", F.when(F.col("_m") >= TOKENS, F.array(*own, *more)).alias("ends"))


def _common_start(a: Column, b: Column) -> Column:
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two token arrays are within one insertion, deletion or substitution."""
    most = F.greatest(F.size(a), F.size(b))
    near = F.abs(F.size(a) - F.size(b)) <= 1
    return near & (_common_start(a, b) + _common_start(F.reverse(a), F.reverse(b)) >= most - 1)


def _fetched(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, doc_id, text_key, pos, norm) of the lines that share an end with another distinct line, at their first place."""
    keys = lines.filter("ends is not null").select("key", F.xxhash64("key").alias("k8"), F.explode("ends").alias("end")).filter("end is not null")
    # more than one distinct line has the end: its least and greatest differ
    shared = keys.groupBy("end").agg(F.min("k8").alias("_a"), F.max("k8").alias("_b")).filter("_a <> _b").select(F.col("end").alias("_e"))
    alive = keys.join(shared, keys["end"] == shared["_e"], "left_semi").select(F.col("key").alias("_k")).distinct()
    first = lines.join(alive, lines["key"] == alive["_k"], "left_semi").groupBy("key").agg(F.min(_place()).alias("_f"))
    wanted = first.groupBy("_f.doc_id", "_f.text_key").agg(F.collect_list(F.struct("_f.pos", "key")).alias("_at"))
    found = docs.join(wanted, null_safe(docs, wanted, ID)).select(*[docs[c] for c in ID], F.split("text", "\n").alias("_ls"), "_at")
    found = found.select(*ID, "_ls", F.explode("_at").alias("_x")).select("_x.key", *ID, "_x.pos", folded(F.get("_ls", F.col("_x.pos"))).alias("norm"))
    return found.dropDuplicates(["key"])  # of rows that repeat id and text


def _variants(left: DataFrame) -> DataFrame:
    """(key, v, i): hashes of the line without its i-th token, and of the whole line for i = -1."""
    w = F.split("norm", " ")
    rows = left.select("key", "norm", w.alias("_w")).select("key", (F.size("_w") >= TOKENS).alias("kind"), tokens(F.col("norm"), F.col("_w")).alias("_t"))
    rows = rows.withColumn("_all", F.aggregate(F.transform("_t", lambda x, i: F.xxhash64(x, i - 1, F.col("kind"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)))
    rows = rows.select("key", "kind", "_all", F.posexplode("_t").alias("i", "_x"))
    rows = rows.select("key", "_all", "i", F.xxhash64("_x", "i", "kind").alias("_a"), F.xxhash64("_x", F.col("i") - 1, "kind").alias("_b"))
    upto = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_ca", F.expr("bit_xor(_a)").over(upto)).withColumn("_cb", F.expr("bit_xor(_b)").over(upto))
    gone = rows.select("key", F.col("_ca").bitwiseXOR(F.col("_a")).bitwiseXOR(F.col("_all")).bitwiseXOR(F.col("_cb")).alias("v"), "i")
    # the running sum over all tokens is the whole line's
    whole = rows.groupBy("key").agg(F.expr("bit_xor(_a)").alias("v")).select("key", "v", F.lit(-1).alias("i"))
    return gone.unionByName(whole)


def near_lines(left: DataFrame) -> DataFrame:
    """(key, partner): of the lines (key, doc_id, text_key, pos, norm) those with an earlier line one edit away, and the earliest found."""
    variants = materialize(_variants(left), "variants")
    several = variants.groupBy("v").agg(F.min(F.xxhash64("key")).alias("_a"), F.max(F.xxhash64("key")).alias("_b")).filter("_a <> _b").select(F.col("v").alias("_v"))
    met = variants.join(several, variants["v"] == several["_v"], "left_semi")
    places = left.select(F.col("key").alias("_k"), F.struct(_place().alias("at"), F.col("key").alias("key")).alias("who"))
    met = materialize(met.join(places, met["key"] == places["_k"]).select("v", "i", "who"), "met")

    by_place = met.groupBy("v", "i").agg(F.min("who").alias("least"))
    by_variant = met.groupBy(F.col("v").alias("_v")).agg(F.min(F.when(F.col("i") < 0, F.col("who"))).alias("whole"), F.min(F.when(F.col("i") >= 0, F.col("who"))).alias("any"))
    groups = by_place.join(by_variant, by_place["v"] == by_variant["_v"]).select("_v", F.col("i").alias("_i"), F.when(F.col("i") < 0, F.col("any")).otherwise(F.least("least", "whole")).alias("best"))
    best = met.join(groups, (met["v"] == groups["_v"]) & (met["i"] == groups["_i"])).filter("best < who").groupBy(F.col("who.key").alias("_k")).agg(F.min("best").alias("best")).select("_k", F.col("best.key").alias("partner"))
    pairs = left.select("key", F.col("norm").alias("mine")).join(best, F.col("key") == F.col("_k")).select("key", "mine", "partner")
    other = left.select(F.col("key").alias("_p"), F.col("norm").alias("theirs"))
    pairs = pairs.join(other, pairs["partner"] == other["_p"])
    split = lambda c: tokens(F.col(c), F.split(c, " "))
    return pairs.select("key", "partner", split("mine").alias("_a"), split("theirs").alias("_b")).filter(one_edit(F.col("_a"), F.col("_b"))).select("key", "partner")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept) for every row of ``docs`` (doc_id, text); ``kept`` is the remaining text."""
    docs = _named(docs)
    lines = materialize(_lines(docs), "line-places")
    first = lines.groupBy("key").agg(F.min(_place()).alias("first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("key").alias("_k"), "first")
    near = near_lines(materialize(_fetched(docs, lines), "lines")).select(F.col("key").alias("_k"), F.lit(True).alias("near"))
    marks = materialize(first.join(near, "_k", "full_outer"), "marks")
    hit = lines.join(marks, lines["key"] == marks["_k"]).filter(F.coalesce("near", F.lit(False)) | (_place() > F.col("first")))
    out = hit.groupBy(*ID).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = docs.join(out, null_safe(docs, out, ID), "left").select(docs["doc_id"], "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    joined = joined.withColumn("_l", F.split("text", "\n"))
    kept = F.when(F.col("text").isNotNull(), without_lines(F.col("text"), F.col("_l"), F.col("gone")))
    return joined.select("doc_id", F.coalesce(F.when(F.col("text").isNotNull(), F.size("_l")), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def oracle() -> str:
    ws = r"[\x20\x09-\x0D]+"
    return rf"""
with d as (select distinct doc_id, coalesce(text, '') t, md5(coalesce(text, '')) k from documents),
l as (select doc_id, k, unnest(range(len(string_split(t, chr(10))))) p, string_split(t, chr(10)) ls from d),
n as (select {{'a': doc_id is null, 'd': doc_id, 'k': k, 'p': p}} f, k, p, ls[p + 1] l, trim(regexp_replace(lower(ls[p + 1]), '{ws}', ' ', 'g')) x from l),
f as (select x, min(f) f from n where x <> '' group by x),
w as (select x, f, case when len(string_split(x, ' ')) >= {TOKENS} then 'w' else 'c' end c,
  case when len(string_split(x, ' ')) >= {TOKENS} then string_split(x, ' ') else list_transform(range(1, length(x) + 1), lambda i: substring(x, i, 1)) end w from f),
t as (select x, f, c, w, case when c = 'w' then ' ' else '' end s from w where len(w) >= {TOKENS}),
v as (select x, f, -1 i, c || x v from t union all select x, f, i, c || case c when 'w' then array_to_string(list_concat(w[:i], w[i + 2:]), ' ') else array_to_string(list_concat(w[:i], w[i + 2:]), '') end from (select x, f, c, w, unnest(range(len(w))) i from t)),
g as (select v, min(f) filter (where i < 0) whole, min(f) filter (where i >= 0) a from v group by v having count(*) > 1),
h as (select v, i, min(f) f from v where i >= 0 group by all),
near as (select distinct v.x from v join g using (v) left join h on v.v = h.v and v.i = h.i where (v.i < 0 and g.a < v.f) or (v.i >= 0 and (h.f < v.f or g.whole < v.f))),
m as (select n.f.d doc_id, n.k, n.p, n.l, n.x <> '' and (f.f < n.f or near.x is not null) gone from n left join f using (x) left join near using (x)),
r as (select doc_id, k, count(*) n_lines, count(*) filter (where gone) n_removed, coalesce(string_agg(l, chr(10) order by p) filter (where gone is not true), '') kept from m group by doc_id, k)
select d.doc_id, (case when d.text is null then 0 else n_lines end)::bigint n_lines, n_removed::bigint n_removed, case when d.text is not null then md5(kept) end kept_md5
from documents d join r on d.doc_id is not distinct from r.doc_id and md5(coalesce(d.text, '')) = r.k
"""
