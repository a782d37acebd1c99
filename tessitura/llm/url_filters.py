"""URL filters by hashed host-suffix and path-prefix expressions (operator 3).

Every distinct url is expanded into host suffixes x path prefixes (at each slash); every rule
into its host and its path up to the last slash. Both are joined on the first 32 bits of the
SHA-256 of the expression; then the full digests and the rest of the rule's path are
confirmed. Of the rules that fit a url the one with the longest host and path together wins,
then the longer host, then ``block``.

Expressions deeper than any rule's are not made, since no rule could equal them; this drops
no match. Rules join as any table does: the planner broadcasts them where they are small.

Defined cases: a null url or one without ``://`` has empty host and path and gets the default
verdict; repeated rows are judged alike; rules that repeat count once; an empty rule table
leaves everything to the default; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower

#: The contract's rules: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(_after(url), r"^[^/?#]*", "")
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    empty = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*rows) if rows else empty))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    stem = F.regexp_extract("path", r"^(?s:.*)/", 0)
    rules = rules.distinct().select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), stem.alias("_stem"))
    deepest = rules.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("_stem", "/")) - 1)).first()
    labels, slashes = int(deepest[0] or 0), int(deepest[1] or 0)
    rules = rules.withColumn("r_digest", F.sha2(F.concat("r_host", "_stem"), 256)).withColumn("r_short", F.substring("r_digest", 1, PREFIX_DIGITS)).drop("_stem")

    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    parts = F.split("h", r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    hosts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), ".")))
    m = F.least(F.size(F.split("p", "/")) - 1, F.lit(slashes))
    stems = F.concat(F.array(F.lit("")), F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(F.array_join(F.slice(F.split("p", "/"), 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    exprs = urls.select("url", "p", F.explode(hosts).alias("_h"), stems.alias("_s")).select("url", "p", F.explode(F.transform("_s", lambda s: F.concat("_h", s))).alias("_e"))
    exprs = exprs.withColumn("digest", F.sha2("_e", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    fits = exprs.join(rules, exprs["short"] == rules["r_short"]).filter((F.col("digest") == F.col("r_digest")) & F.startswith("p", "r_path"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block")
    best = fits.groupBy(F.col("url").alias("_url")).agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("_best"))
    out = pages.join(best, pages["url"].eqNullSafe(best["_url"]), "left")
    text = F.coalesce(F.col("url"), F.lit(""))
    return out.select(*[pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host_of(text).alias("host"), path_of(text).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.r_verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, RULES)).drop("url")


def oracle() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
with r(rh, rp, rv) as (values {values}),
a as (select row_number() over () i, page_id, case when position('://' in url) > 0 then url[position('://' in url) + 3:] else '' end u from pages),
b as (select i, page_id, translate(regexp_extract(coalesce(u, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(regexp_replace(coalesce(u, ''), '^[^/?#]*', ''), '^[^?#]*') path from a),
f as (select i, rh || rp rule, rv, row_number() over (partition by i order by length(rh) + length(rp) desc, length(rh) desc) k
  from b join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(rv, 'allow') verdict from b left join (select * from f where k = 1) using (i)
"""
