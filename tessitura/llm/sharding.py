"""Hierarchical weighted hash tree sharding (operator 7). DataFrame functions only.

A row descends region, rack and shard. At each level every child draws an exponential number
from a hash of the row's id and the child's name, divided by the child's weight (the sum of
the shards below it); the smallest draw wins. A child's draw depends on nothing but its own
name and weight, so a change of weights moves rows only into or out of subtrees whose weights
changed. A shard added under a region of its own takes rows only into itself.

Law ``key``: doc_id and the tree alone decide. ``slot`` numbers the rows of a shard from 0
without gaps in the order of the id's hash; it comes from per-bucket counts and ranks inside
buckets, so no task holds a shard.

Defined cases: a null id is hashed as the text ``null``; a null text has no bytes, size 1 and
checksum 0; repeated rows share a shard and get slots of their own; an empty table gives no
rows; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import text_or_empty

#: Hex digits of the id's hash that name a bucket: 4096 buckets a shard.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """Equal shards, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [Leaf(f"g{s // (per_rack * racks)}", f"k{s // per_rack}", s) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard in a region and rack of its own."""
    s = max(x.shard for x in tree) + 1
    return [*tree, Leaf(f"g+{s}", f"k+{s}", s, weight)]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential number of rate ``weight`` from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def _pick(key: Column, children: dict[str, float]) -> Column:
    """The name of the child with the smallest draw; equal draws go to the smaller name."""
    names = sorted(children)
    if len(names) == 1:
        return F.lit(names[0])
    return F.array_min(F.array(*[F.struct(draw(key, n, children[n]).alias("d"), F.lit(n).alias("n")) for n in names]))["n"]


def _descend(level: Column, parents: dict[str, dict[str, float]], key: Column) -> Column:
    out = None
    for p in sorted(parents):
        hit, pick = level == p, _pick(key, parents[p])
        out = F.when(hit, pick) if out is None else out.when(hit, pick)
    return out


def place(rows: DataFrame, tree: list[Leaf], key: str, out: str) -> DataFrame:
    """``rows`` with the shard of each in column ``out``; ``key`` is a text column."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs shards of positive weight")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        k = f"{x.region}/{x.rack}"
        below = racks.setdefault(x.region, {})
        below[k] = below.get(k, 0.0) + x.weight
        shards.setdefault(k, {})[f"{k}/{x.shard:06d}"] = x.weight
    rows = rows.withColumn("_region", _pick(F.col(key), regions))
    rows = rows.withColumn("_rack", _descend(F.col("_region"), racks, F.col(key)))
    rows = rows.withColumn("_leaf", _descend(F.col("_rack"), shards, F.col(key)))
    return rows.withColumn(out, F.substring_index("_leaf", "/", -1).cast("int")).drop("_region", "_rack", "_leaf")


def number(rows: DataFrame, group: str, order: list[str], bucket: str, out: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 by (``bucket``, ``order``) without bringing a group together."""
    counts = rows.groupBy(group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    ranked = rows.withColumn("_rank", within)
    joined = ranked.join(starts, (ranked[group] == starts["_g"]) & (ranked[bucket] == starts["_b"]))
    return joined.withColumn(out, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_g", "_b", "_start", "_rank")


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    tree = even_tree(shards)
    rows = docs.select("doc_id", (F.octet_length(text_or_empty(F.col("text"))) + 1).cast("long").alias("size"), F.crc32(text_or_empty(F.col("text"))).cast("long").alias("text_crc32"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = place(place(rows, tree, "_key", "shard"), grown(tree), "_key", "grown_shard")
    rows = rows.withColumn("_hash", F.md5("_key")).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    rows = number(rows, "shard", ["_hash", "text_crc32", "size"], "_bucket", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return shard_rows(table(spark, sf_dir, "documents"))


def _sql_pick(children: dict[str, float]) -> str:
    def one(n: str) -> str:
        return f"{{'d': -ln((('0x' || md5(k || '/{n}')[1:13])::bigint + 0.5::double) / 4503599627370496::double) / {children[n]}::double, 'n': '{n}'}}"

    return f"'{next(iter(children))}'" if len(children) == 1 else f"list_min([{', '.join(one(n) for n in sorted(children))}]).n"


def _sql_place(tree: list[Leaf], src: str) -> str:
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        k = f"{x.region}/{x.rack}"
        racks.setdefault(x.region, {})[k] = racks.setdefault(x.region, {}).get(k, 0.0) + x.weight
        shards.setdefault(k, {})[f"{k}/{x.shard:06d}"] = x.weight
    case = lambda col, of: "case " + " ".join(f"when {col} = '{p}' then {_sql_pick(of[p])}" for p in sorted(of)) + " end"
    return f"select *, {case('rack', shards)} leaf from (select *, {case('region', racks)} rack from (select *, {_sql_pick(regions)} region from {src}))"


def oracle(shards: int = 8) -> str:
    table = []
    for i in range(256):  # of the standard checksum, by its rule
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    tree = even_tree(shards)
    return f"""
with t as (select doc_id, encode(coalesce(text, '')) b, coalesce(doc_id::varchar, 'null') k from documents),
h as (select doc_id, k, hex(b) x, octet_length(b) n from t),
r as (select doc_id, k, (n + 1)::bigint size,
  xor(list_reduce(list_transform(range(0, n + 1), lambda i: case when i = 0 then 4294967295::bigint else ('0x' || x[2 * i - 1:2 * i])::bigint end),
    lambda c, y: xor(c >> 8, ({table}::bigint[])[xor(c & 255, y) + 1])), 4294967295::bigint) text_crc32 from h),
p as (select *, leaf.split('/')[-1]::int shard from ({_sql_place(tree, 'r')})),
q as (select doc_id, k, size, text_crc32, shard from p),
g as (select *, leaf.split('/')[-1]::int grown_shard from ({_sql_place(grown(tree), 'q')}))
select doc_id, size, text_crc32, 'key' law, shard, (row_number() over (partition by shard order by md5(k), text_crc32, size) - 1)::bigint slot, grown_shard from g
"""
