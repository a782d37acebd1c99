"""Tool-call linking (operator 4). DataFrame functions only.

Calls and results are hash-joined by identifier. A call may name one earlier call
(``parent_id``) whose result it waits for; the level of a call is its distance from a call
that waits for nothing, found by pointer doubling, so a chain of n calls takes log2(n)
joins. Sorting by (level, call_id) orders the calls topologically. Arguments are checked
against the tool's schema and each call is serialised with its result as canonical JSON: keys
in order, no spaces, nulls dropped.

One row per different call leaves ``link``; calls of a conversation are never gathered. ``everything`` adds a row for
each different call or result that could not be linked, so no content is lost.

Defined cases: of calls or results that repeat an identifier the smallest is linked
(chosen before any join; ``n_copies`` counts them), different others are ``duplicate``; a null identifier is
``unidentified``; a call
without a result is ``unanswered``; arguments that are null, no JSON object or against the
schema are ``invalid`` with reasons in ``errors``; a tool without a schema is an error;
parents that don't exist are ignored; calls on a cycle or behind one have a null level and
status ``cycle``; results without a call are ``orphan``. Rows that are equal in all are one. An empty table gives no rows;
other columns are not touched; texts of any length go whole into the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.session import materialize

#: The tool that the conversation table's turns are read as calls of.
REPLY = {"reply": {"text": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}}}
JSON_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def argument_errors(name: Column, parsed: Column, schemas: dict) -> Column:
    """Why the parsed arguments don't fit the tool's schema; empty if they do."""
    kind = F.schema_of_variant(parsed)
    checks = []
    for tool, fields in sorted(schemas.items()):
        here = name == tool
        for field, rule in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            if rule.get("required"):
                checks.append(F.when(here & absent, F.lit(f"{field}: missing")))
            of = F.schema_of_variant(value)
            fits = F.lit(False)
            for t in JSON_TYPES[rule["type"]]:
                fits = fits | of.startswith(t)
            checks.append(F.when(here & ~absent & ~fits, F.lit(f"{field}: not {rule['type']}")))
            if "min_length" in rule:
                checks.append(F.when(here & (F.length(F.try_variant_get(parsed, f"$.{field}", "string")) < rule["min_length"]), F.lit(f"{field}: too short")))
            if "minimum" in rule:
                checks.append(F.when(here & (F.try_variant_get(parsed, f"$.{field}", "double") < rule["minimum"]), F.lit(f"{field}: too small")))
    known = name.isin(*sorted(schemas)) if schemas else F.lit(False)
    allowed = None
    for tool, fields in sorted(schemas.items()):
        listed = F.array(*[F.lit(f) for f in sorted(fields)])
        allowed = F.when(name == tool, listed) if allowed is None else allowed.when(name == tool, listed)
    text = F.to_json(parsed)
    extra = F.array_sort(F.array_except(F.json_object_keys(text), allowed)) if allowed is not None else F.array().cast("array<string>")
    checks.append(F.when(~F.coalesce(known, F.lit(False)), F.lit("no such tool")))
    checks.append(F.when(parsed.isNull() | ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.lit("arguments: no object")))
    listed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return F.concat(listed, F.coalesce(F.transform(extra, lambda x: F.concat(x, F.lit(": unknown"))), F.array().cast("array<string>")))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) from (call_id, parent_id) with distinct ids."""
    ids = calls.select(F.col("call_id").alias("_p"))
    step = calls.join(ids, calls["parent_id"] == ids["_p"], "left").select("call_id", F.col("_p").alias("up"), F.when(F.col("_p").isNull(), 0).otherwise(1).cast("long").alias("level"))
    step = materialize(step, "tool-levels")
    span, total = 1, step.count()
    while step.filter("up is not null").limit(1).count() and span <= 2 * total:
        above = step.select(F.col("call_id").alias("_c"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        step = step.join(above, step["up"] == above["_c"], "left").select("call_id", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"))
        step, span = materialize(step, "tool-levels"), 2 * span
    return step.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """Calls (call_id, conv_id, name, arguments, parent_id) with results (call_id, content).

    (conv_id, call_id, name, n_copies, level, status, errors, json)
    """
    calls = calls.filter("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_copies"), F.min(F.struct("name", "arguments", "conv_id", "parent_id")).alias("_c")).select("call_id", "n_copies", "_c.*")
    calls = materialize(calls, "tool-calls")
    found = results.filter("call_id is not null").groupBy(F.col("call_id").alias("_r")).agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    order = levels(calls.select("call_id", "parent_id")).withColumnRenamed("call_id", "_l")
    out = calls.join(found, calls["call_id"] == found["_r"], "left").join(order, F.col("call_id") == F.col("_l"))
    out = out.withColumn("_v", F.try_parse_json("arguments"))
    out = out.withColumn("errors", argument_errors(F.col("name"), F.col("_v"), schemas))
    status = F.when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(F.col("_r").isNull(), "unanswered").otherwise("ok")
    out = out.withColumn("status", status)
    body = F.to_json(F.struct(F.col("_v").alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status"))
    return out.select("conv_id", "call_id", "name", "n_copies", "level", "status", "errors", body.alias("json"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    ids = calls.select(F.col("call_id").alias("_c")).distinct()
    return results.join(ids, results["call_id"] == ids["_c"], "left_anti")


def unlinked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """What ``link`` leaves out, in its columns: a row for each different call or result, with how many there are."""
    first = calls.filter("call_id is not null").groupBy(F.col("call_id").alias("_id")).agg(F.min(F.struct("name", "arguments", "conv_id", "parent_id")).alias("_first"))
    each = calls.groupBy("call_id", F.struct("name", "arguments", "conv_id", "parent_id").alias("_c")).agg(F.count("*").alias("n_copies"))
    each = each.join(first, each["call_id"] == first["_id"], "left").filter(F.col("_id").isNull() | ~F.col("_c").eqNullSafe(F.col("_first")))
    body = F.to_json(F.struct(F.col("_c.arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("_c.name").alias("name"), F.when(F.col("_id").isNull(), "unidentified").otherwise("duplicate").alias("status")))
    none, no_errors = F.lit(None).cast("long").alias("level"), F.array().cast("array<string>").alias("errors")
    lost_calls = each.select(F.col("_c.conv_id").alias("conv_id"), "call_id", F.col("_c.name").alias("name"), "n_copies", none, F.when(F.col("_id").isNull(), "unidentified").otherwise("duplicate").alias("status"), no_errors, body.alias("json"))

    least = results.filter("call_id is not null").groupBy(F.col("call_id").alias("_rid")).agg(F.min(F.coalesce("content", F.lit(""))).alias("_least"))
    said = results.groupBy("call_id", F.coalesce("content", F.lit("")).alias("content")).agg(F.count("*").alias("n_copies"))
    ids = first.select(F.col("_id").alias("_call"))
    said = said.join(ids, said["call_id"] == ids["_call"], "left").join(least, said["call_id"] == least["_rid"], "left")
    state = F.when(F.col("call_id").isNull(), "unidentified").when(F.col("_call").isNull(), "orphan").when(F.col("content") != F.col("_least"), "duplicate")
    said = said.withColumn("status", state).filter("status is not null")
    body = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"), "status"))
    conv = F.lit(None).cast(calls.schema["conv_id"].dataType).alias("conv_id")
    return lost_calls.unionByName(said.select(conv, "call_id", F.lit(None).cast("string").alias("name"), "n_copies", none, "status", no_errors, body.alias("json")))


def everything(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """``link``, and the rows of ``unlinked``."""
    return link(calls, results, schemas).unionByName(unlinked(calls, results))


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads a chat table as calls and results: each turn that isn't the assistant's calls
    ``reply`` with its text and number; the assistant's next turn is the result; a call
    waits for the one two turns before it."""

    def key(turn: Column) -> Column:
        return F.when(F.col("conv_id").isNotNull() & turn.isNotNull(), F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")))

    asks = turns.filter(~F.coalesce(F.col("role") == "assistant", F.lit(False)))
    calls = asks.select(key(F.col("turn")).alias("call_id"), "conv_id", F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), key(F.col("turn") - 2).alias("parent_id"))
    results = turns.filter(F.col("role") == "assistant").select(key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    calls, results = turns_as_calls(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return everything(calls, results, REPLY).withColumn("errors", F.array_join("errors", "; "))


def oracle() -> str:
    return """
with recursive t as (select conv_id, turn, role, text, conv_id::varchar || '-' || turn::varchar id, conv_id::varchar || '-' || (turn - 1)::varchar before, conv_id::varchar || '-' || (turn - 2)::varchar up from conversations),
asks as (select id, count(*) k, {'n': 'reply', 'a': case when text is null and turn is null then '{}' else '{' || concat_ws(',', '"text":' || to_json(text)::varchar, '"turn":' || turn::varchar) || '}' end, 'c': conv_id, 'p': up} m, any_value(text) t, any_value(turn) u
  from t where role is distinct from 'assistant' group by id, m),
c as (select id, sum(k)::bigint n, arg_min(t, m) t, arg_min(u, m) u, min(m) m from asks where id is not null group by id),
c2 as (select id, n, t, u, m, m.a a, m.c conv_id, m.p up from c),
says as (select before id, coalesce(text, '') content, count(*) k from t where role = 'assistant' group by all),
r as (select id, min(content) content from says where id is not null group by 1),
l as (select id, 0::bigint level from c2 where up is null or up not in (select id from c2) union all select c2.id, l.level + 1 from c2 join l on c2.up = l.id),
o as (select c2.conv_id, c2.id call_id, 'reply' name, n n_copies, level,
  case when t is null then 'text: missing' when length(t) < 1 then 'text: too short' else '' end errors, r.id is not null answered, a, content
  from c2 join l using (id) left join r using (id)),
s as (select *, case when errors <> '' then 'invalid' when not answered then 'unanswered' else 'ok' end status from o),
lost as (select asks.m.c conv_id, asks.id call_id, 'reply' name, k n_copies, case when asks.id is null then 'unidentified' else 'duplicate' end status, asks.m.a a from asks left join c2 using (id) where asks.id is null or asks.m <> c2.m),
mute as (select says.id, says.content, k, case when says.id is null then 'unidentified' when c2.id is null then 'orphan' when says.content <> r.content then 'duplicate' end status from says left join c2 on says.id = c2.id left join r on says.id = r.id)
select conv_id, call_id, name, n_copies, level, status, errors,
  '{"arguments":' || a || ',"id":"' || call_id || '","level":' || level || ',"name":"reply"' || case when content is null then '' else ',"result":' || to_json(content)::varchar end || ',"status":"' || status || '"}' json
from s
union all select conv_id, call_id, name, n_copies, null, status, '', '{"arguments":' || to_json(a)::varchar || case when call_id is null then '' else ',"id":"' || call_id || '"' end || ',"name":"reply","status":"' || status || '"}' from lost
union all select null, id, null, k, null, status, '', '{' || case when id is null then '' else '"id":"' || id || '",' end || '"result":' || to_json(content)::varchar || ',"status":"' || status || '"}' from mute where status is not null
"""
