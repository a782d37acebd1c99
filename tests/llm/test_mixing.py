import math
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tessitura.llm import mixing as M


def weights(spark, counts, **kw):
    df = spark.createDataFrame(list(counts.items()), "source string, tokens long")
    return {r["source"]: r for r in M.source_weights(df, M.MixTarget(**kw)).collect()}


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def test_entropy_target_is_met_exactly(spark):
    got = weights(spark, {"a": 900, "b": 90, "c": 10}, target_entropy=0.8, max_repeat=1e9)
    w = [got[s]["weight"] for s in "abc"]
    assert abs(sum(w) - 1) < 1e-9 and abs(entropy(w) - 0.8 * math.log(3)) < 1e-6
    a = got["a"]["exponent"]
    z = sum(p**a for p in (0.9, 0.09, 0.01))
    assert all(abs(x - p**a / z) < 1e-9 for x, p in zip(w, (0.9, 0.09, 0.01)))


def test_repetition_limit_prevails(spark):
    got = weights(spark, {"a": 9000, "b": 900, "c": 100}, target_entropy=1.0, max_repeat=3.0)
    assert abs(max(r["quota"] / r["tokens"] for r in got.values()) - 3.0) < 0.01 and got["a"]["quota"] == 9000
    fixed = weights(spark, {"a": 9000, "b": 1000}, target_entropy=1.0, max_repeat=2.0, budget=5000)
    assert abs(fixed["b"]["quota"] / 1000 - 2.0) < 0.01


def test_plan_realises_the_quotas(docs, rows):
    target = M.MixTarget(block_tokens=500)
    plan = M.plan(docs, target).collect()
    tokens = {i: len((r[1] or "").split()) for i, r in enumerate(rows)}
    total = Counter()
    for i, r in enumerate(rows):
        total[r[3]] += tokens[i]
    seen = Counter(r["doc_id"] for r in plan)
    assert all(seen[r[0]] >= 1 for r in rows)  # no document is lost
    used = Counter()
    for r in plan:
        used[r["source"]] += r["n_tokens"]
    want = {r["source"]: r["quota"] for r in M.source_weights(docs.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), ""))).cast("long").alias("tokens")), target).collect()}
    longest = max(tokens.values())
    assert all(want[s] <= used[s] + 1 and used[s] < want[s] + longest for s in want)
    for b in {r["block"] for r in plan}:
        assert sorted(r["position"] for r in plan if r["block"] == b) == list(range(sum(r["block"] == b for r in plan)))


def test_mix_keeps_columns_and_empty(docs, empty, rows):
    clash = docs.withColumn("text_key", F.lit("t")).withColumn("epoch", F.lit(7))
    out = M.mix(clash)
    assert out.columns == clash.columns
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
    assert M.plan(empty).count() == 0 and M.mix(empty).count() == 0


def chain_hash(*values):
    """The engine's 64-bit hash of longs and ints, one seeding the next; nulls are passed over."""
    h = 42
    for v, size in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(int(v).to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_plan(rows, quotas, blocks, seed):
    """(doc_id, source, n_tokens, epoch, block, position) of every appearance, in plain loops."""
    by, out = {}, []
    for r in rows:
        text = r[1] or ""
        key = xxhash.xxh64_intdigest(text.encode(), 42)
        by.setdefault(r[3], []).append((r[0], key - (1 << 64) if key >= 1 << 63 else key, len(text.split())))
    for source, docs in by.items():
        tokens, quota = sum(d[2] for d in docs), quotas[source]
        for epoch in range(max(1, math.ceil(quota / tokens)) if tokens else 1):
            hashed = [(chain_hash((i, 8), (k, 8), (epoch, 8), (seed, 4)), i, k, n) for i, k, n in docs if n or epoch == 0]
            at = epoch * tokens
            for h, i, k, n in sorted(hashed, key=lambda x: ((x[0] % (1 << 64)) >> 52, x[0], x[1] is not None, x[1] or 0, x[2])):
                if at < quota or n == 0:
                    block = math.floor(at * (blocks / quota)) if quota else h % blocks
                    out.append((i, source, k, n, epoch, min(blocks - 1, block), h))
                at += n
    placed = []
    for b in {x[5] for x in out}:
        inside = sorted((x for x in out if x[5] == b), key=lambda x: (chain_hash((x[6], 8), (b, 8)), x[0] is not None, x[0] or 0, x[2], x[4]))
        placed += [(x[0], x[1], x[3], x[4], b, p) for p, x in enumerate(inside)]
    return placed


def test_plan_against_plain_loops(docs, rows):
    target = M.MixTarget(block_tokens=700)
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["block"], r["position"]) for r in M.plan(docs, target).collect())
    counts = docs.groupBy("source").agg(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), ""))).cast("long").alias("tokens"))
    weights = M.source_weights(counts, target).collect()
    quotas, blocks = {r["source"]: r["quota"] for r in weights}, max(1, math.ceil(weights[0]["budget"] / target.block_tokens))
    assert got == Counter(brute_plan(rows, quotas, blocks, target.seed)) and blocks > 5 and any(x[3] > 0 for x in got)
