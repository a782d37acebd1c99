"""WARC archives with a two-level capture index (operator 2).

Writing: tasks write gzip members, one record each, to archive files under the shared folder.
Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest
page_id is the response, the others are revisits that refer to it; the choice is made on
(digest, id) rows before the writing. File names are unique to a task attempt and the capture
table, committed by Spark, names only the files of attempts that counted, so a lost executor
costs a repeated task and a stray file.

Index: captures are range-partitioned and sorted by reversed-host URL key, time and id. Each
partition is a shard: a file of compressed blocks of ``BLOCK`` lines, and a sparse directory
with the first key and the place of each block. Lookup: binary search in the list of shards (first
keys; one entry for some million captures), then in the shard's directory, then one range read and
decompression of the block, then one range read of the record in its archive.

Defined cases: a null html is an empty payload; a null url has the empty key; repeated rows
are records of their own (equal ids with equal payloads are all responses); an empty table
writes nothing and finds nothing; other columns are not archived.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower
from tessitura.session import materialize, new_path

STAMP = "20240101000000"
BLOCK = 1024
SHARD_CAPTURES = 2_000_000
ROLL_BYTES = 1 << 30
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed: the standard's name space for URLs
CAPTURE = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the rest of the url; white space is escaped."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_replace(rest, r"^[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat_ws(" ", url_key(url), F.lit(STAMP), F.lpad(F.coalesce(page_id.cast("string"), F.lit("-")), 20, "0"))


def _open(root: str):
    return fs.FileSystem.from_uri(root)


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def _safe(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, not compressed. A revisit holds the HTTP head only."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {STAMP[:4]}-{STAMP[4:6]}-{STAMP[6:8]}T00:00:00Z"]
    head += [f"WARC-Target-URI: {_safe(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of a record; raises if the payload doesn't have the digest that is stated."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (sha1(payload) != digest or len(payload) != int(fields["X-Payload-Bytes"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    own, to = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    uri = fields.get("WARC-Target-URI")
    return {"page_id": None if own is None else int(own), "url": None if uri is None else _plain(uri), "record_type": fields["WARC-Type"], "payload_bytes": int(fields["X-Payload-Bytes"]), "payload_digest": digest, "refers_to": None if to is None else int(to), "payload": payload}


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(raw: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def gunzip(raw: bytes) -> bytes:
    return zlib.decompress(raw, 31)


def _writer(root: str):
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def run(batches):
        where, path = _open(root)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            html = batch.column("html").cast(pa.large_binary()).to_pylist()
            for key, page_id, url, body, to in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "url")), html, batch.column("refers_to").to_pylist(), strict=True):
                payload = body or b""
                digest = sha1(payload)
                raw = gzip_member(record(page_id, url, payload, digest, to))
                if out is None or at > ROLL_BYTES:
                    if out:
                        out.close()
                    where.create_dir(path, recursive=True)
                    name, at = f"crawl-{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                out.write(raw)
                rows.append((key, page_id, url, "response" if to is None else "revisit", len(payload), digest, to, name, at, len(raw)))
                at += len(raw)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_arrow(CAPTURE))
        if out:
            out.close()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def write(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Archives (page_id, url, html); gives the capture table and the archives' folder."""
    root = new_path(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.withColumn("_sha", F.sha1(body.cast("binary")))
    first = pages.filter(F.octet_length(body) >= min_bytes).groupBy(F.col("_sha").alias("_d")).agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    # identifiers and digests alone meet by digest; the bodies are dealt by page, so copies of one don't meet
    slim = pages.filter(F.octet_length(body) >= min_bytes).select(F.col("page_id").alias("_id"), F.col("_sha").alias("_s")).distinct()
    refers = slim.join(first, slim["_s"] == first["_d"]).filter(F.col("first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first"))).select("_id", "_s", "first")
    marked = pages.join(refers, pages["page_id"].eqNullSafe(refers["_id"]) & (pages["_sha"] == refers["_s"]), "left")
    rows = marked.select(capture_key(F.col("url"), F.col("page_id")).alias("key"), "page_id", "url", "html", F.col("first").alias("refers_to"))
    return materialize(rows.mapInArrow(_writer(root), CAPTURE), "captures"), root


def _indexer(root: str):
    ddl = "first_key string, last_key string, shard string, blocks int, captures long"

    def run(batches):
        where, path = _open(root)
        name, out, at, held, directory, last, total = f"index-{uuid.uuid4().hex}", None, 0, [], [], "", 0

        def flush():
            nonlocal at, held
            raw = gzip_member("".join(held).encode(), 6)
            out.write(raw)
            directory.append((held[0].split("\t", 1)[0], at, len(raw)))
            at, held = at + len(raw), []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}.blocks", compression=None)
                held.append(f"{row['key']}\t{json.dumps({'f': row['file'], 'o': row['offset'], 'l': row['length']})}\n")
                last, total = row["key"], total + 1
                if len(held) == BLOCK:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with where.open_output_stream(f"{path}/{name}.directory", compression=None) as d:
                d.write("".join(f"{k}\t{o}\t{n}\n" for k, o, n in directory).encode())
            yield pa.RecordBatch.from_pylist([{"first_key": directory[0][0], "last_key": last, "shard": name, "blocks": len(directory), "captures": total}], schema=_arrow(ddl))

    return run, ddl


def build_index(captures: DataFrame, root: str) -> DataFrame:
    """Writes shards beside the archives; gives the table of shards."""
    n = captures.count()
    run, ddl = _indexer(root)
    ranged = captures.select("key", "file", "offset", "length").repartitionByRange(max(8, n // SHARD_CAPTURES), "key").sortWithinPartitions("key", "file", "offset")
    return materialize(ranged.mapInArrow(run, ddl), "shards")


class Reader:
    """Looks keys up in the index; keys that come in order read each block once."""

    def __init__(self, root: str, shards: list[tuple[str, str]]):
        self.where, self.path = _open(root)
        self.first, self.names = [k for k, _ in shards], [n for _, n in shards]
        self.directories: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make, most: int):
        if key not in cache:
            cache[key] = make()
            if len(cache) > most:
                cache.popitem(last=False)
        cache.move_to_end(key)
        return cache[key]

    def _read(self, name: str, offset: int, length: int) -> bytes:
        f = self._kept(self.files, name, lambda: self.where.open_input_file(f"{self.path}/{name}"), 64)
        return f.read_at(length, offset)

    def _directory(self, shard: str):
        def make():
            with self.where.open_input_stream(f"{self.path}/{shard}.directory", compression=None) as f:
                rows = [x.split("\t") for x in f.read().decode().split("\n") if x]
            return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

        return self._kept(self.directories, shard, make, 4)

    def _block(self, shard: str, offset: int, length: int):
        def make():
            lines = gunzip(self._read(f"{shard}.blocks", offset, length)).decode().split("\n")[:-1]
            return [x.split("\t", 1)[0] for x in lines], lines

        return self._kept(self.blocks, (shard, offset), make, 4)

    def captures(self, key: str):
        """(file, offset, length) of all captures of a key."""
        s = bisect.bisect_right(self.first, key) - 1
        if s < 0:
            return
        firsts, places = self._directory(self.names[s])
        b = max(0, bisect.bisect_left(firsts, key) - 1)
        while b < len(firsts) and firsts[b] <= key:
            keys, lines = self._block(self.names[s], *places[b])
            i = bisect.bisect_left(keys, key)
            while i < len(keys) and keys[i] == key:
                x = json.loads(lines[i].split("\t", 1)[1])
                yield x["f"], x["o"], x["l"]
                i += 1
            b += 1

    def records(self, key: str):
        for file, offset, length in self.captures(key):
            yield {**parse(gunzip(self._read(file, offset, length))), "file": file, "offset": offset}


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long"


def lookup(keys: DataFrame, shards: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """The records of the distinct capture keys (column ``key``), read by way of the index."""
    spark = keys.sparkSession
    listed = sorted((r["first_key"], r["shard"]) for r in shards.select("first_key", "shard").collect())  # one for some million captures
    held = spark.sparkContext.broadcast(listed)
    ddl = FOUND + (", payload binary" if with_payload else "")
    schema = pa.schema([*_arrow(FOUND), *([("payload", pa.binary())] if with_payload else [])])

    def run(batches):
        reader = Reader(root, held.value)
        for batch in batches:
            rows = []
            for k in batch.column("key").to_pylist():
                rows += [{n: r[n] for n in schema.names} for r in reader.records(k)]
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select("key").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, ddl)


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captures, root = write(pages)
    shards = build_index(captures, root)
    found = lookup(pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key")), shards, root)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def oracle() -> str:
    """Base32 comes from SHA-1's 40 hex digits, four characters from each five."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, url, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) x from pages),
f as (select x, min(page_id) first from p group by x)
select page_id, n::bigint payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: ('{digits}')[(((('0x' || x[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::int]), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id = first then null else first end refers_to, url
from p join f using (x)
"""

