"""Merkle manifest of a dataset (operator 11).

Each row is a leaf; per source the leaves, by doc_id, are folded sixteen at a time until one node is left,
and the sources' roots likewise. Spark numbers the leaves (range partitions, counts, no source in one task) and deals
them to blocks of 4096 that are aligned with three levels of the tree. Executors hand the blocks as Arrow
tables to DuckDB, whose queries (ordered ``string_agg``, ``sha256``) fold them. Spark combines the blocks' roots level by
level, and each block is joined with the proof of its root; a second pass of DuckDB queries makes every leaf's proof and folds
the tampered leaf up to the root.

Texts are read once; from then on a row is two digests and three numbers. Siblings inside a block never leave
its task.

Defined cases: null values have a leaf form of their own; null doc_ids come first, repeated doc_ids by their
leaf's digest, and rows that repeat altogether have a place each; a null doc_id isn't tampered with; null is a source, the
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower
from tessitura.session import materialize

#: Fixed by the contract: children of a node, and every fifth checksum is tampered with.
ARITY, TAMPERED = 16, 5
#: Levels of the tree inside a block.
INNER = 3
BLOCK = ARITY**INNER
#: Hex digits of a digest.
HEX = 64
ROW = ["srank", "block", "pos", "n", "doc_id", "leaf", "tampered"]


def field(c: Column) -> Column:
    """A value with its byte count before it, or a dash for null."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered) of every row; ``tampered`` is null where nothing is done to the row."""
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    return materialize(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(ascii_lower(F.col("text")))).alias("tampered")), "leaves")


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``pos``, from 0 in each group by ``order`` (null first), and the group's size ``n``.

    Range partitions are sorted and written; a row's place is that in its partition plus the counts of those before.
    """
    by = [F.asc_nulls_first(c) for c in [*group, *order]]
    rows = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    runs = rows.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    whole, before = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    joined = rows.join(runs, same_names([*group, "_part"]))
    return joined.select(*df.columns, (F.col("_id") + F.col("_shift")).alias("pos"), "n")


def same_names(names: list[str]) -> Column:
    """Each column equals its namesake of the other side, null included."""
    on = F.lit(True)
    for c in names:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return on


def _inner_sql(rows: str) -> str:
    """CTEs of the runs r1, r2, r3 of each level in a block and the nodes h1, h2, h3 that they fold to.

    A level folds only where the source has several nodes there; a source's only node goes up as it is.
    """
    out, src, at, h = [], rows, "pos", "leaf"
    for k in range(1, INNER + 1):
        out.append(f"r{k} as (select srank, {at} // {ARITY} at{k}, any_value(n) n, string_agg({h}, '' order by {at}) run from {src} group by all)")
        out.append(f"h{k} as (select srank, at{k}, n, case when n > {ARITY ** (k - 1)} then sha256(run) else run end node from r{k})")
        src, at, h = f"h{k}", f"at{k}", "node"
    return ",\n".join(out)


def roots_sql() -> str:
    """The root of each block of the table ``block``."""
    return f"with {_inner_sql('block')} select srank, at{INNER} block, n, node from h{INNER}"


def proofs_sql(outer: int) -> str:
    """Each leaf's proof and fold; rows of ``block`` without a place carry the proof of the block's root, of up to ``outer`` levels."""
    runs = "\n".join(f"  join r{k} on t.srank = r{k}.srank and t.pos // {ARITY**k} = r{k}.at{k}" for k in range(1, INNER + 1))
    own = ", ".join(f"case when t.n > {ARITY ** (k - 1)} then substr(r{k}.run, 1, {HEX} * (t.pos // {ARITY ** (k - 1)} % {ARITY})) else '' end l{k}, case when t.n > {ARITY ** (k - 1)} then substr(r{k}.run, {HEX} * (t.pos // {ARITY ** (k - 1)} % {ARITY}) + {HEX + 1}) else '' end g{k}" for k in range(1, INNER + 1))
    folds, last = [], "j"
    for k in range(1, INNER + 1):
        folds.append(f"f{k} as (select * exclude (f), case when n > {ARITY ** (k - 1)} then sha256(l{k} || f || g{k}) else f end f from {last})")
        last = f"f{k}"
    for k in range(1, outer + 1):
        folds.append(f"o{k} as (select * exclude (f), case when len(lefts) >= {k} then sha256(lefts[{k}] || f || rights[{k}]) else f end f from {last})")
        last = f"o{k}"
    siblings = " || ".join(f"l{k} || g{k}" for k in range(1, INNER + 1))
    return f"""with t as (select * from block where pos is not null), o as (select srank, block, lefts, rights, subroot, root from block where pos is null),
{_inner_sql("t")},
j as (select t.doc_id, t.leaf, t.n, o.lefts, o.rights, o.subroot, o.root, {own}, coalesce(t.tampered, t.leaf) f from t
{runs}
  join o on t.srank = o.srank and t.block = o.block),
{", ".join(folds)}
select doc_id, leaf, subroot, root, sha256({siblings} || coalesce(array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), ''), '')) proof_sha256,
  f folded_root, f = root verified from {last}"""


def _whole_blocks(batches, least: int = BLOCK):
    """Arrow tables of whole blocks, of ``least`` rows or more, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        s, b = t["srank"].to_numpy(), t["block"].to_numpy()
        ends = np.flatnonzero((s[1:] != s[:-1]) | (b[1:] != b[:-1]))
        if len(ends):
            yield t.slice(0, ends[-1] + 1)
            held = t.slice(ends[-1] + 1).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def in_duckdb(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """``sql`` over the whole blocks of ``rows`` (srank, block, pos, ...), each task with an engine of its own, in memory."""
    target = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB"})
        try:
            for t in _whole_blocks(batches):
                con.register("block", t)
                yield from con.sql(sql).to_arrow_table().cast(target).to_batches(max_chunksize=BLOCK)
                con.unregister("block")
        finally:
            con.close()

    return rows.repartition("srank", "block").sortWithinPartitions("srank", "block", "pos").mapInArrow(run, schema)


def _levels(count: int) -> int:
    """Levels until one node is left."""
    k = 0
    while count > 1:
        count, k = -(-count // ARITY), k + 1
    return k


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, pos, lefts, rights, root) of the nodes (g, pos, count, node), ``count`` of them in group g: siblings level by level, and the last node."""
    paths = nodes.select("g", "pos", "count", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    now = nodes.select("g", F.col("pos").alias("at"), "count", "node")
    for k in range(levels):
        several = F.col("count") > F.lit(ARITY**k)
        run = now.groupBy("g", F.expr(f"at div {ARITY}").alias("up")).agg(F.max("count").alias("count"), F.array_sort(F.collect_list(F.struct("at", "node"))).alias("m"))
        run = run.select("g", "up", "count", F.array_join("m.node", "").alias("run"))
        place = F.expr(f"int(pos div {ARITY**k} % {ARITY})")
        up = run.select(F.col("g").alias("_g"), F.col("up").alias("_up"), "run")
        joined = paths.join(up, (F.col("g") == F.col("_g")) & (F.expr(f"pos div {ARITY ** (k + 1)}") == F.col("_up")))
        more = lambda to, part: F.when(several, F.concat(to, F.array(part))).otherwise(F.col(to))
        left, right = F.substring("run", F.lit(1), place * HEX), F.substring("run", place * HEX + HEX + 1, F.lit(ARITY * HEX))
        paths = joined.select("g", "pos", "count", more("lefts", left).alias("lefts"), more("rights", right).alias("rights"))
        now = run.select("g", F.col("up").alias("at"), "count", F.when(several, F.sha2("run", 256)).otherwise(F.col("run")).alias("node"))
    tops = now.select(F.col("g").alias("_g"), F.col("node").alias("root"))
    return paths.join(tops, F.col("g") == F.col("_g")).select("g", "pos", "lefts", "rights", "root")


PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """PROOF rows of every row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    rows = numbered(leaves(docs), ["source"], ["doc_id", "leaf"])
    sources = numbered(rows.groupBy("source").agg(F.max("n").alias("leaves")), [], ["source"]).select("source", F.col("pos").alias("srank"), F.col("n").alias("sources"))
    names = materialize(sources, "sources").withColumnRenamed("source", "_of_source")
    rows = rows.join(names, same_names(["source"])).select("srank", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "doc_id", "leaf", "tampered", "sources")
    rows = materialize(rows, "placed")
    most = rows.agg(F.max("n"), F.max("sources")).first()
    if most[0] is None:
        return docs.sparkSession.createDataFrame([], PROOF)
    tops = materialize(in_duckdb(rows.select(*ROW), roots_sql(), "srank bigint, block bigint, n bigint, node string"), "block-roots")
    up, over = _levels(math.ceil(most[0] / BLOCK)), _levels(most[1])
    count = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
    inside = climb(tops.select(F.col("srank").alias("g"), F.col("block").alias("pos"), count.alias("count"), "node"), up)
    subroots = inside.filter("pos = 0").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(most[1]).cast("long").alias("count"), F.col("root").alias("node"))
    above = climb(subroots, over).select(F.col("pos").alias("_srank"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), F.col("root").alias("_root"))
    outer = inside.join(above, F.col("g") == F.col("_srank")).select(F.col("g").alias("srank"), F.col("pos").alias("block"), F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"), F.col("root").alias("subroot"), F.col("_root").alias("root"))
    both = rows.select(*ROW).unionByName(outer, allowMissingColumns=True)
    return in_duckdb(both, proofs_sql(up + over), PROOF)


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return manifest(table(spark, sf_dir, "documents"))


def oracle(deep: int = 6, wide: int = 4) -> str:
    """The same by plain SQL, for sources of up to 16^deep rows and up to 16^wide sources."""
    crcs = []
    for i in range(256):  # of the standard checksum, by its rule
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        crcs.append(i)
    one = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(one(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        f"c as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii((doc_id::varchar)[i])::bigint)), lambda c, y: xor(c >> 8, ({crcs}::bigint[])[xor(c & 255, y) + 1])), 4294967295::bigint) crc from documents)",
        f"l as (select doc_id, source, sha256({head} || {one('text')}) leaf, case when crc % {TAMPERED} = 0 then sha256({head} || {one(lower)}) end bad from c)",
        "s as (select source, row_number() over (order by source nulls first) - 1 srank, count(*) over () sources, n from (select source, count(*) n from l group by 1))",
        "t as (select l.*, srank, sources, n, row_number() over (partition by srank order by doc_id nulls first, leaf) - 1 pos, row_number() over () id from l join s on l.source is not distinct from s.source)",
        "v0 as (select srank, pos spot, leaf node, n from t)",
    ]
    last = "select id, doc_id, leaf, srank, pos, n, sources, coalesce(bad, leaf) f, '' proof from t"

    def level(k: int, name: str, src: str, group: str, size: str, place: str) -> None:
        nonlocal last
        step, many = ARITY ** (k - 1), f"{size} > {ARITY ** (k - 1)}"
        parts.append(f"{name}r{k} as (select {group}, spot // {ARITY} up, any_value({size}) {size}, string_agg(node, '' order by spot) run from {src} group by all)")
        parts.append(f"{name}{k} as (select {group}, up spot, {size}, case when {many} then sha256(run) else run end node from {name}r{k})")
        i = f"({place} // {step} % {ARITY}) * {HEX}"
        left, right = f"case when p.{many} then substr(run, 1, {i}) else '' end", f"case when p.{many} then substr(run, {i} + {HEX + 1}) else '' end"
        parts.append(f"{name}p{k} as (select p.* exclude (f, proof), proof || {left} || {right} proof, case when p.{many} then sha256({left} || f || {right}) else f end f from ({last}) p join {name}r{k} r on {'p.srank = r.srank and ' if group == 'srank' else ''}{place} // {ARITY**k} = r.up)")
        last = f"select * from {name}p{k}"

    for k in range(1, deep + 1):
        level(k, "v", f"v{k - 1}", "srank", "n", "pos")
    parts.append(f"w0 as (select 0 g, srank spot, node, (select max(sources) from t) sources from v{deep})")
    for k in range(1, wide + 1):
        level(k, "w", f"w{k - 1}", "g", "sources", "srank")
    return f"""with {", ".join(parts)}
select doc_id, leaf, v.node subroot, w.node root, sha256(proof) proof_sha256, f folded_root, f = w.node verified from ({last}) p join v{deep} v using (srank) cross join w{wide} w"""
