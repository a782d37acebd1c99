import json

from tessitura.llm import tool_calls as T

SCHEMAS = {"add": {"a": {"type": "integer", "required": True}, "b": {"type": "number", "minimum": 0}}, "say": {"text": {"type": "string", "required": True, "min_length": 1}}}


def run(spark, calls, results):
    c = spark.createDataFrame(calls, "call_id string, conv_id long, name string, arguments string, parent_id string")
    r = spark.createDataFrame(results, "call_id string, content string")
    return {x["call_id"]: x for x in T.link(c, r, SCHEMAS).collect()}


def test_link_order_validate_serialise(spark):
    calls = [("c1", 1, "add", '{"b": 2.5, "a": 1}', None), ("c2", 1, "say", '{"text": "hi"}', "c1"), ("c3", 1, "say", '{"text": ""}', "c2"), ("c4", 1, "add", '{"a": "x", "z": 1, "b": -1}', "gone"), ("c5", 1, "nope", "{}", None), ("c6", 1, "say", "not json", None), ("c7", 1, "say", None, None), ("c8", 1, "say", "[1]", None), ("c9", 1, "say", '{"text": "a"}', "c10"), ("c10", 1, "say", '{"text": "b"}', "c9"), (None, 1, "say", "{}", None), ("c1", 1, "add", '{"b": 2.5, "a": 1}', None)]
    got = run(spark, calls, [("c1", "3"), ("c1", "9"), ("c3", None), ("lost", "x"), ("c9", "y")])
    assert {k: v["level"] for k, v in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": 0, "c5": 0, "c6": 0, "c7": 0, "c8": 0, "c9": None, "c10": None}
    assert {k: v["status"] for k, v in got.items()} == {"c1": "ok", "c2": "unanswered", "c3": "invalid", "c4": "invalid", "c5": "invalid", "c6": "invalid", "c7": "invalid", "c8": "invalid", "c9": "cycle", "c10": "cycle"}
    assert got["c1"]["n_copies"] == 2 and got["c1"]["json"] == '{"arguments":{"a":1,"b":2.5},"id":"c1","level":0,"name":"add","result":"3","status":"ok"}'
    assert sorted(got["c4"]["errors"]) == ["a: not integer", "b: too small", "z: unknown"]
    assert all(list(json.loads(v["json"])) == sorted(json.loads(v["json"])) for v in got.values())


def test_long_chain_and_empty(spark):
    n = 70
    got = run(spark, [(f"k{i}", 1, "say", '{"text":"t"}', f"k{i - 1}") for i in range(n)], [])
    assert all(got[f"k{i}"]["level"] == i for i in range(n))
    assert run(spark, [], []) == {}
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, 2, "user", "x"), (1, 2, None, None)], "conv_id long, turn long, role string, text string")
    calls, results = T.turns_as_calls(turns)
    out = {r["call_id"]: r["status"] for r in T.link(calls, results, T.REPLY).collect()}
    assert out == {"1-0": "ok", "1-2": "invalid"}
    assert T.orphans(calls, results).count() == 0


def test_nothing_is_lost(spark):
    """Different calls and results under one identifier, null identifiers, results without a call; clashing columns, very long texts."""
    calls = [("a", 1, "say", '{"text":"x"}', None), ("a", 1, "say", '{"text":"y"}', None), ("a", 1, "say", '{"text":"y"}', None), (None, 2, "say", "{}", None), (None, 2, "say", "{}", None), ("b", 3, "say", json.dumps({"text": "z" * 200_000}), "a")]
    results = [("a", "one"), ("a", "two"), ("a", "one"), ("gone", "late"), (None, None), ("b", "w" * 300_000)]
    c = spark.createDataFrame([(*x, "s", 1) for x in calls], "call_id string, conv_id long, name string, arguments string, parent_id string, status string, level int")
    r = spark.createDataFrame([(*x, 0) for x in results], "call_id string, content string, n_copies int")
    got = sorted(((x["status"], x["call_id"] or "", x["name"] or "", x["n_copies"]) for x in T.everything(c, r, SCHEMAS).collect()))
    assert got == sorted([("ok", "a", "say", 3), ("duplicate", "a", "say", 2), ("unidentified", "", "say", 2), ("ok", "b", "say", 1), ("duplicate", "a", "", 1), ("orphan", "gone", "", 1), ("unidentified", "", "", 1)])
    whole = {x["call_id"]: json.loads(x["json"]) for x in T.link(c, r, SCHEMAS).collect()}
    assert len(whole["b"]["result"]) == 300_000 and len(whole["b"]["arguments"]["text"]) == 200_000 and whole["b"]["level"] == 1


def test_levels_against_plain_loops(spark):
    import random

    rng = random.Random(5)
    parent = {f"n{i}": (None if rng.random() < 0.2 else f"n{rng.randrange(60)}") for i in range(60)}

    def level(k):
        seen = set()
        while parent.get(k) is not None:
            if k in seen:
                return None
            seen.add(k)
            k = parent[k]
        return len(seen)

    got = run(spark, [(k, 1, "say", '{"text":"t"}', p) for k, p in parent.items()], [])
    assert {k: v["level"] for k, v in got.items()} == {k: level(k) for k in parent}
    order = {k: i for i, k in enumerate(sorted((k for k in got if got[k]["level"] is not None), key=lambda k: (got[k]["level"], k)))}
    assert all(order[parent[k]] < order[k] for k in order if parent[k] in order)
