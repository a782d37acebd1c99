import zlib

from tessitura.llm import sharding as S


def test_contract(docs, rows):
    got = S.shard_rows(docs).collect()
    assert len(got) == len(rows)
    by_text = {r[0]: (r[1] or "").encode() for r in rows}
    slots = {}
    for r in got:
        assert r["size"] == len(by_text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(by_text[r["doc_id"]])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_and_confined_movement(spark):
    df = spark.range(20000).selectExpr("cast(id as string) k")
    tree = [S.Leaf("a", "r1", 0, 1.0), S.Leaf("a", "r1", 1, 1.0), S.Leaf("a", "r2", 2, 2.0), S.Leaf("b", "r3", 3, 4.0)]
    heavier = [*tree[:3], S.Leaf("b", "r3", 3, 8.0)]
    both = S.place(S.place(df, tree, "k", "x"), heavier, "k", "y").groupBy("x", "y").count().collect()
    share = {s: sum(r["count"] for r in both if r["x"] == s) / 20000 for s in range(4)}
    assert all(abs(share[s] - w) < 0.02 for s, w in enumerate((0.125, 0.125, 0.25, 0.5)))
    assert all(r["x"] == r["y"] or r["y"] == 3 for r in both)
    more = S.place(S.place(df, S.even_tree(8), "k", "x"), S.grown(S.even_tree(8)), "k", "y").filter("x <> y").select("y").distinct().collect()
    assert [r[0] for r in more] == [8]


def test_empty_and_null_ids(spark, empty):
    assert S.shard_rows(empty).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    got = S.shard_rows(df).collect()
    assert sorted(r["slot"] for r in got) == [0, 1] and len({r["shard"] for r in got}) == 1
