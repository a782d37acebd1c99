import base64
import hashlib

from pyarrow import fs

from tessitura.llm import warc as W

PAGES = [(1, "http://a.example.com/x?b=1", "<p>é</p>"), (2, "http://b.example.com/", "<p>é</p>"), (3, None, None), (4, "http://A.example.com/x y\r\nz", ""), (5, "no scheme", "q" * 200000), (6, "http://c.org/%0A", "tail\r\n\r\n"), (6, "http://c.org/%0A", "tail\r\n\r\n"), (None, "http://n.org/", "null id")]


def want(min_bytes=0):
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, u, h in PAGES:
        b = (h or "").encode()
        to = first.get(h or "") if len(b) >= min_bytes else None
        to = None if to == i else to
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to, u))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip_by_the_index(spark, monkeypatch):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, key string")
    for least in (0, 5):
        captures, root = W.write(df, least)
        shards = W.build_index(captures, root)
        found = W.lookup(captures.select("key"), shards, root, with_payload=True).collect()
        assert order([tuple(r)[:6] for r in found]) == order(want(least))
        body = {r["page_id"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
        assert body[5] == b"q" * 200000 and body[6] == b"tail\r\n\r\n" and body[1] == "<p>é</p>".encode()


def test_keys_blocks_and_absent_keys(spark):
    n = 3000
    df = spark.range(n).selectExpr("id page_id", "concat('http://h', id % 7, '.com/', id) url", "concat('body', id % 1000) html")
    captures, root = W.write(df)
    shards = W.build_index(captures, root)
    assert sum(r["blocks"] for r in shards.collect()) >= 3 and sum(r["captures"] for r in shards.collect()) == n
    reader = W.Reader(root, sorted((r["first_key"], r["shard"]) for r in shards.collect()))
    keys = [r["key"] for r in captures.select("key").collect()]
    assert all(len(list(reader.captures(k))) == 1 for k in keys[::97])
    assert not list(reader.captures("")) and not list(reader.captures("zzz")) and not list(reader.captures(keys[0] + "x"))
    assert W.lookup(captures.select("key"), shards, root).count() == n
    where, path = fs.FileSystem.from_uri(root)
    assert any(f.path.endswith(".directory") for f in where.get_file_info(fs.FileSelector(path)))


def test_url_keys_and_empty(spark):
    df = spark.createDataFrame([("http://www.Example.COM/a b?q",), (None,)], "url string")
    assert [r[0] for r in df.select(W.url_key(df["url"])).collect()] == ["com,example,www)/a%20b?q", ")"]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    captures, root = W.write(none)
    assert W.lookup(captures.select("key"), W.build_index(captures, root), root).count() == 0
