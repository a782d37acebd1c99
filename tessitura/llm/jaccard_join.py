"""N-gram Jaccard join in metric space (operator 9).

Documents are sets of distinct 5-word shingles under Jaccard distance d = 1 - J; two link at
d <= 0.2. Pivots cut the space into Voronoi regions, the triangle inequality says which documents
a region must see besides its own, and regions are joined recursively and exactly.

1. Equal sets are one class, named by 128 bits; everything below works on classes.
2. Two texts that share no shingle have distance 1, as almost all pairs do, so the space first
   falls apart by single shingles: in any total order of all shingles a class of n shingles
   can only link with one that shares s of its first n - ceil(0.8 n) + s. For s we take a 20th of the
   smaller class's shingles, 3 at least, as one shingle in common chains most of a large table into
   one region of texts that are all far from each other. Shared shingles are counted by pair where
   up to ``PAIRS`` classes have one; a shingle of more connects them by stars of edges by size.
   The order is by a fixed-size count sketch of all shingles' frequencies, so frequent shingles
   connect little. The components of this graph are the first regions. The sets of the classes
   in them are written once.
3. A region whose members hold more than ``region_limit`` shingles goes through step 2 among its like,
   with a sketch that is sharper by as much as they are fewer, as long as that halves them; then
   it is cut by pivots: each class is measured against the region's pivots and belongs to
   the cell of the nearest (or, beyond ``FAR`` of all, to the outside). A pair is met in the cell of
   one of the two, to which the other is copied if its window reaches: d(y, p) at most
   d(y, its own pivot) + 0.4, and at most FAR + 0.2. Links with pivots are known then, and pivots
   leave. In a cell all within 0.2 of the pivot are one component, so those leave too whose
   own window, 0.2 further out, holds nothing else. Rows of a region are dealt over many tasks.
4. Regions within the limit are joined in tasks: split once more by the exact local order, then
   by the same cells, recursively; up to ``LEAF`` classes are compared with each other.

Nothing is sampled or capped. The driver gets the sketch (a fixed 16 MB; 4 MB go out) and counts.

Defined cases: a null text or one without words has the empty set and links with nothing;
repeated rows and equal sets share a component; a null ``doc_id`` counts as no smallest id
unless alone; ids of any type that has an order; an empty table gives no rows; other columns are not
touched. ``keep_one`` keeps one row of each component (smallest id, null last, then the text's hash) and
every row without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessitura.llm.common import null_safe, text_or_empty
from tessitura.llm.components import components
from tessitura.llm.shingle import pack, parts, set_name, shingle_sets, unpack
from tessitura.session import discard, materialize, release

K = 5
PERCENT = 80
SKETCH_BITS = 22
CHUNK = 1 << 14
#: Shingles that the members of a region may hold in one task.
REGION_LIMIT = 4_000_000
#: Keys of a bucket and shingles of a task, about.
BUCKET_KEYS, TASK_SHINGLES = 400_000, 2_000_000
#: Classes that are compared with each other.
LEAF = 16
#: Classes of one shingle whose pairs are counted; an edge of a star counts for so many.
PAIRS, STAR = 32, 1 << 40
#: Links reach so far (a trifle more, for rounding); beyond FAR of all pivots a class is outside.
REACH, FAR = 1 - PERCENT / 100 + 1e-9, 0.6


def needed(n):
    """The least overlap that a class of n shingles needs for a link."""
    return (PERCENT * n + 99) // 100


def sure(n):
    """Shingles that a class of n and one of n or more share, if they link, among the first of each: n - needed(n) + sure(n)."""
    return np.minimum(needed(n), np.maximum(3, n // 20))


def linked(shared, n, m):
    """Jaccard similarity of at least 0.8, in integers."""
    return 100 * shared >= PERCENT * (n + m - shared)


def _counted(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    if any(len(s) for s in sets):
        cell, n = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
        sketch[cell] += n.astype(np.int32)


def _chunks(sketch: np.ndarray) -> tuple[pa.Array, pa.Array]:
    rows = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, CHUNK)  # more in one task is frequent enough
    full = np.flatnonzero(rows.any(axis=1))
    return pa.array(full, pa.int32()), pa.array([rows[i].tobytes() for i in full], pa.binary())


def _scan(batches):
    """Rows of documents, then rows of the sketch's chunks."""
    sketch, kind = np.zeros(1 << SKETCH_BITS, np.int32), None
    for batch in parts(batches):
        kind = batch.column("doc_id").type
        sets = shingle_sets(batch.column("text"), K)
        cls = pa.array([set_name(s) if len(s) else None for s in sets], pa.binary())
        _counted(sketch, sets)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array([len(s) for s in sets], pa.int64()), cls, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "name", "n", "cls", "chunk", "counts"])
    if kind is not None:
        chunk, counts = _chunks(sketch)
        empty = pa.nulls(len(chunk), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(chunk), kind), empty, pa.nulls(len(chunk), pa.int64()), empty, chunk, counts], names=["doc_id", "name", "n", "cls", "chunk", "counts"])


def _sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _count_sets(batches):
    """The sketch's chunks of sets that are written already."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in batches:
        _counted(sketch, _sets_of(batch.column("set")))
    chunk, counts = _chunks(sketch)
    yield pa.RecordBatch.from_arrays([chunk, counts], names=["chunk", "counts"])


def _adder(kind):
    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for blob in table.column("counts").to_pylist():
            total += np.frombuffer(blob, kind)
        total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return add


def _sketch(chunks: DataFrame) -> np.ndarray:
    """The rank, 0 to 255, of each cell of the sketch: 64 for the mean, 64 log2(1 + count / mean)."""
    schema = "chunk int, salt int, counts binary"
    rows = chunks.filter("chunk is not null").select("chunk", F.pmod(F.xxhash64("counts"), F.lit(256)).cast("int").alias("salt"), "counts")
    rows = rows.groupBy("chunk", "salt").applyInArrow(_adder(np.uint8), schema).groupBy("chunk").applyInArrow(_adder(np.uint32), schema)
    out = np.zeros(((1 << SKETCH_BITS) // CHUNK, CHUNK), np.float64)
    for r in rows.select("chunk", "counts").collect():  # 256 rows of 64 KB
        out[r["chunk"]] = np.frombuffer(r["counts"], np.uint32)
    out = out.ravel()
    return np.minimum(255, 64 * np.log2(1 + out / max(out.mean(), 1e-9))).astype(np.uint8)


def _ordered(s: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of each shingle in the global order: rare ones first."""
    return (rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s & np.uint64((1 << 56) - 1))


def node_of(name: bytes) -> int:
    """The class's node in the graph of candidates; two that share one only share a region."""
    return int.from_bytes(name[:8], "big", signed=True)


def _node():
    return F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long")


_PREFIX = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("node", pa.binary()), ("n", pa.binary())])


def _prefixes(rank, buckets: int, column: str):
    def run(batches):
        seen, held, size = set(), [], 0
        order = rank.value

        def flush():
            keys, node, n = (np.concatenate(x) for x in zip(*held, strict=True))
            return pack((keys % np.uint64(buckets)).astype(np.int64), [keys, node, n], _PREFIX)

        for batch in parts(batches) if column == "text" else batches:
            for s in shingle_sets(batch.column("text"), K) if column == "text" else _sets_of(batch.column("set")):
                n = len(s)
                if not n or (c := node_of(set_name(s))) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(c)
                p = n - needed(n) + int(sure(n))
                keys = _ordered(s, order)
                if p < n:
                    keys = np.partition(keys, p - 1)[:p]
                held.append((keys, np.full(len(keys), c, np.int64), np.full(len(keys), n, np.int32)))
                size += len(keys)
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _edges(table: pa.Table) -> pa.Table:
    """Pairs of classes that sizes let link, how many shingles of this bucket they share and how many are needed; stars need no more."""
    key, node, n = unpack(table.column("key"), np.uint64), unpack(table.column("node"), np.int64), unpack(table.column("n"), np.int32)
    order = np.argsort(key, kind="stable")
    key, node, n = key[order], node[order], n[order].astype(np.int64)
    again = np.r_[False, key[1:] == key[:-1]] if len(key) else np.empty(0, bool)
    held = again | np.r_[again[1:], False] if len(key) else again  # keys of one row connect nothing
    key, node, n = key[held], node[held], n[held]
    order = np.lexsort((node, n, key))
    key, node, n = key[order], node[order], n[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    key, node, n = key[fresh], node[fresh], n[fresh]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    ends = np.r_[first[1:], len(key)][: len(first)]
    few = ends - first <= PAIRS
    at, step, pairs = np.flatnonzero(np.repeat(few, ends - first)), 1, []
    while len(at):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & (n[at] >= needed(n[at + step]))]  # larger ones follow
        x, y = node[at], node[at + step]
        pairs.append(np.column_stack((np.maximum(x, y), np.minimum(x, y), sure(n[at]))))
        step += 1
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
    pairs, shared = np.unique(pairs, axis=0, return_counts=True)
    edges = []
    for a, b in zip(first[~few], ends[~few], strict=True):
        while a < b - 1:
            size = n[a:b]
            e = int(np.searchsorted(size, size[0] * 100 // PERCENT, side="right"))  # sizes up to 1.25 times
            if e > 1:
                edges.append(np.column_stack((np.full(e - 1, node[a]), node[a + 1 : a + e])))
            last = a + e - 1
            if last + 1 < b and n[last] >= needed(n[last + 1]):
                edges.append(np.array([[node[last], node[last + 1]]]))
            a = last + 1
    e = np.unique(np.sort(np.concatenate(edges), axis=1), axis=0) if edges else np.empty((0, 2), np.int64)
    both = np.concatenate((pairs[:, :2], e[:, ::-1]))
    shared, least = np.concatenate((shared, np.full(len(e), STAR))), np.concatenate((pairs[:, 2], np.zeros(len(e), np.int64)))
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "shared": pa.array(shared, pa.int64()), "least": pa.array(least, pa.int64())})


def _regions(rows: DataFrame, column: str, chunks: DataFrame, total: int) -> DataFrame:
    """(node, label) of all classes of ``rows`` that share enough of their first shingles with another."""
    rank = rows.sparkSession.sparkContext.broadcast(_sketch(chunks))
    buckets = max(64, int(total * 0.26) // BUCKET_KEYS)
    packed = rows.select(column).mapInArrow(_prefixes(rank, buckets, column), "bucket long, key binary, node binary, n binary")
    edges = packed.groupBy("bucket").applyInArrow(_edges, "a long, b long, shared long, least long")
    edges = edges.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
    return components(edges.filter("shared >= least").select("a", "b"))


def overlaps(pivots: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, a line for each of the rows."""
    k, out = len(pivots), np.zeros((len(rows), len(pivots)), np.int64)
    flat, whose = np.concatenate(pivots), np.repeat(np.arange(k), [len(p) for p in pivots])
    order = np.argsort(flat, kind="stable")
    whose = whose[order]
    known, begin, count = np.unique(flat[order], return_index=True, return_counts=True)
    sizes = np.cumsum([len(r) for r in rows])
    step = max(256, 2_000_000 // k)  # each element may meet all pivots
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + 500_000, side="right")))
        x, owner = np.concatenate(rows[a:b]), np.repeat(np.arange(a, b), [len(r) for r in rows[a:b]])
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        hit = known[at] == x
        at, owner = at[hit], owner[hit]
        for i in range(0, len(at), step):
            n, own = count[at[i : i + step]], owner[i : i + step]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[i : i + step]], n)
            lo, hi = int(own[0]), int(own[-1]) + 1
            out[lo:hi] += np.bincount(np.repeat(own - lo, n) * k + whose[places], minlength=(hi - lo) * k).reshape(hi - lo, k)
        a = b
    return out


def deal(shared: np.ndarray, n: np.ndarray, m: np.ndarray, member: np.ndarray):
    """(row, cell, whether a member there, distance) of all rows in all cells that must see them; cell len(m) is the outside."""
    k = len(m)
    d = 1.0 - shared / (n[:, None] + m[None, :] - shared)
    home, least = d.argmin(1), d.min(1)
    far = least > FAR
    window = np.where(far, FAR + REACH, np.minimum(least + 2 * REACH, FAR + REACH))
    seen = d <= window[:, None]
    # of two members the cell of the smaller number sees both; a far member is met outside
    seen &= ~member[:, None] | (~far[:, None] & (np.arange(k)[None, :] < home[:, None]))
    row, cell = np.nonzero(seen)
    parts = [(row, cell, np.zeros(len(row), bool), d[row, cell])]
    near = np.flatnonzero(member & ~far)
    parts.append((near, home[near], np.ones(len(near), bool), least[near]))
    rim = np.flatnonzero(far | (least > FAR - REACH))
    parts.append((rim, np.full(len(rim), k), (member & far)[rim], least[rim]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class Region:
    """Joins sets exactly: members with each other and with those that are no members."""

    def __init__(self, sets: list[np.ndarray], member: np.ndarray | None = None):
        self.sets, self.n = sets, np.array([len(s) for s in sets], np.int64)
        self.member = np.ones(len(sets), bool) if member is None else member
        self.links = _Union(len(sets))

    def split(self, idx: np.ndarray) -> list[np.ndarray]:
        """Parts that can't link with each other, by prefixes in the exact local order."""
        flat = np.concatenate([self.sets[i] for i in idx])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]], dtype=np.int32)
        del flat
        count = np.bincount(number)
        shingle = np.empty(len(order), np.int32)
        shingle[order] = number
        del order, number
        firsts, at = [], 0
        for n in self.n[idx].tolist():
            own = shingle[at : at + n].astype(np.int64)
            key, p = count[own] << 32 | own, n - needed(n) + 1  # rare ones first
            firsts.append((np.partition(key, p - 1)[:p] if p < n else key) & 0xFFFFFFFF)
            at += n
        shingle, who = np.concatenate(firsts), np.repeat(np.arange(len(idx)), [len(f) for f in firsts])
        by = np.argsort(shingle, kind="stable")
        shingle, who = shingle[by], who[by]
        same = np.flatnonzero(shingle[1:] == shingle[:-1])
        part = _Union(len(idx))
        for x, y in np.unique(np.column_stack((who[same], who[same + 1])), axis=0).tolist():
            part.join(x, y)
        roots = np.array([part.find(i) for i in range(len(idx))])
        by = np.argsort(roots, kind="stable")
        return np.split(idx[by], np.flatnonzero(np.diff(roots[by])) + 1)

    def solve(self) -> list[int]:
        todo = [(part, self.member[part]) for part in self.split(np.arange(len(self.sets)))] if self.sets else []
        while todo:
            idx, member = todo.pop()
            if len(idx) > 1 and member.any():
                roots = {self.links.find(i) for i in idx.tolist()}
                if len(roots) > 1:
                    todo += self.cells(idx, member)
        return [self.links.find(i) for i in range(len(self.sets))]

    def cells(self, idx: np.ndarray, member: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links the pivots with all others; the cells that are left to be joined."""
        inside = np.flatnonzero(member)
        chosen = inside if len(idx) <= LEAF else inside[: max(4, min(64, len(inside) // 32))]
        shared = overlaps([self.sets[i] for i in idx[chosen]], [self.sets[i] for i in idx])
        n, m = self.n[idx], self.n[idx[chosen]]
        for x, p in zip(*(y.tolist() for y in np.nonzero(linked(shared, n[:, None], m[None, :]))), strict=True):
            self.links.join(int(idx[x]), int(idx[chosen[p]]))
        if len(chosen) == len(inside):
            return []
        row, cell, own, d = deal(shared, n, m, member)
        left = ~np.isin(row, chosen)  # pivots have met everyone
        row, cell, own, d = row[left], cell[left], own[left], d[left]
        ball = (cell < len(m)) & linked(shared[row, np.minimum(cell, len(m) - 1)], n[row], m[np.minimum(cell, len(m) - 1)])
        rim = np.full(len(m) + 1, np.inf)
        np.minimum.at(rim, cell[~ball], d[~ball])
        left = ~ball | (d >= rim[cell] - REACH)
        row, cell, own = row[left], cell[left], own[left]
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        return [(idx[row[part]], own[part]) for part in np.split(order, cuts)]


ROWS = "region long, cls binary, n long, set binary, member boolean"


def _sets(batches):
    """The sets of the classes' texts, one of each in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for i, c in enumerate(batch.column("cls").to_pylist()):
            if c not in seen:
                fresh.append(i)
                if len(seen) < 1 << 20:
                    seen.add(c)
        batch = batch.take(pa.array(fresh, pa.int64()))
        sets = shingle_sets(batch.column("text"), K)
        yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("cls"), batch.column("n"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([True] * len(sets), pa.bool_())], names=["region", "cls", "n", "set", "member"])


def _measure(key: tuple[pa.Scalar, ...], rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Deals some rows of a region to the cells of its pivots; a row without a set is a link."""
    names, sets, member = rows.column("cls").to_pylist(), _sets_of(rows.column("set")), np.array(rows.column("member").to_pylist(), bool)
    pivot = dict(zip(pivots.column("p_cls").to_pylist(), _sets_of(pivots.column("p_set")), strict=True))
    order = sorted(pivot)
    out = {c: [] for c in ("cls", "n", "set", "member", "cell", "d", "ball", "pivot")}

    def put(*values):
        for c, v in zip(out, values, strict=True):
            out[c].append(v)

    if names and order:
        n, m = np.array([len(s) for s in sets], np.int64), np.array([len(pivot[p]) for p in order], np.int64)
        shared = overlaps([pivot[p] for p in order], sets)
        near = linked(shared, n[:, None], m[None, :])
        tree, known = _Union(len(order)), None
        for x in np.flatnonzero(near.any(1)).tolist():
            ball = np.flatnonzero(near[x]).tolist()
            put(names[x], None, None, None, None, None, None, order[ball[0]])
            for p in ball[1:]:  # a tree of the pivots, whatever the number of rows
                if tree.find(p) != (known := tree.find(ball[0])):
                    tree.join(p, known)
                    put(order[p], None, None, None, None, None, None, order[ball[0]])
        for x, c, own, d in zip(*(y.tolist() for y in deal(shared, n, m, member)), strict=True):
            if names[x] not in pivot:
                put(names[x], int(n[x]), sets[x].tobytes(), own, c, d, bool(c < len(m) and near[x, c]), None)
    return pa.table({"region": pa.array([key[0].as_py()] * len(out["cls"]), pa.int64()), **{c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.float64(), pa.bool_(), pa.binary()), strict=True)}})


def _cut(rows: DataFrame, sizes: DataFrame, limit: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """One round of cells for regions that are too large: (a, b) links of classes, and the rows of the cells."""
    place = F.xxhash64("cls", F.lit(turn))
    first = rows.filter("member").groupBy("region").agg(F.min(F.struct(place.alias("p"), "cls")).alias("_f")).select(F.col("region").alias("_r"), F.col("_f.cls").alias("_first"))
    plan = sizes.join(first, sizes["region"] == first["_r"]).select(
        "_r",
        "_first",
        F.ceil(F.col("weight") / F.lit(limit)).alias("salts"),
        # about 1 member in 32, between 8 and 256 of a region
        F.greatest(F.lit(1), F.ceil(F.col("members") / F.greatest(F.lit(8), F.least(F.lit(256), F.col("members") / 32)))).alias("every"),
    )
    rows = rows.join(plan, rows["region"] == plan["_r"])
    pivots = rows.filter("member").filter((F.pmod(place, F.col("every")) == 0) | (F.col("cls") == F.col("_first")))
    pivots = pivots.select(F.col("region").alias("p_region"), F.col("cls").alias("p_cls"), F.col("set").alias("p_set"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("p_salt"))
    dealt = rows.select("region", "cls", "set", "member", F.pmod(F.xxhash64("cls"), F.col("salts")).alias("salt"))
    ddl = "region long, cls binary, n long, set binary, member boolean, cell int, d double, ball boolean, pivot binary"
    measured = materialize(dealt.groupBy("region", "salt").cogroup(pivots.groupBy("p_region", "p_salt")).applyInArrow(_measure, ddl), "cells")
    links = measured.filter("pivot is not null and cls <> pivot").select(F.greatest("cls", "pivot").alias("a"), F.least("cls", "pivot").alias("b"))
    cells = measured.filter("pivot is null").withColumn("region", F.xxhash64("region", "cell", F.lit(turn)))
    # a cell without members links nothing
    state = cells.groupBy(F.col("region").alias("_r")).agg(F.min(F.when(~F.col("ball"), F.col("d"))).alias("_rim"), F.max("member").alias("_some"))
    left = cells.join(state, cells["region"] == state["_r"]).filter(F.col("_some") & (~F.col("ball") | (F.col("d") >= F.col("_rim") - REACH)))
    links, left = materialize(links, "pivot-links"), materialize(left.select("region", "cls", "n", "set", "member"), "cut")
    discard(measured)
    return links, left


def _solve(table: pa.Table) -> pa.Table:
    """(a, b): the classes of one task's regions that link, and the smallest of each component there."""
    by: dict[int, dict[bytes, tuple[np.ndarray, bool]]] = {}
    for r, c, s, m in zip(table.column("region").to_pylist(), table.column("cls").to_pylist(), _sets_of(table.column("set")), table.column("member").to_pylist(), strict=True):
        region = by.setdefault(r, {})
        region[c] = (s, m or (c in region and region[c][1]))
    a, b = [], []
    for region in by.values():
        names = sorted(region)
        for i, root in enumerate(Region([region[c][0] for c in names], np.array([region[c][1] for c in names], bool)).solve()):
            if i != root:
                a.append(names[i])
                b.append(names[root])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _sizes(rows: DataFrame) -> DataFrame:
    inside = F.when(F.col("member"), F.col("n")).otherwise(0)
    return rows.groupBy("region").agg(F.sum("n").alias("weight"), F.sum(inside).alias("own"), F.sum(F.col("member").cast("long")).alias("members"))


def _joined(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(a, b) links of classes, written, and whether they still are edges rather than a member and its component's name.

    Takes over the table ``rows``: each table of sets goes as soon as what follows from it is written.
    """
    spark = rows.sparkSession
    done, found, before, turn = [], [], None, 0
    while True:
        sizes = _sizes(rows)
        over = (F.col("own") > limit) & (F.col("members") > 1)
        size, whole = sizes.agg(F.sum(F.when(over, F.col("own"))), F.sum("weight")).first()
        if not size:
            done.append(rows)
            break
        big = materialize(sizes.filter(over), "big")
        small = big.select(F.col("region").alias("_r"))
        inside = materialize(rows.join(small, rows["region"] == small["_r"], "left_semi"), "inside")
        rest = rows.join(small, rows["region"] == small["_r"], "left_anti")
        if 2 * size > whole:  # else what is left stays where it is
            rest = materialize(rest, "small")
            discard(rows)
        done.append(rest)
        release(spark)
        if not found and (before is None or size <= 0.5 * before):
            regions = _regions(inside, "set", inside.select("set").mapInArrow(_count_sets, "chunk int, counts binary"), size)
            named = inside.withColumn("_n", _node())
            rows = materialize(named.join(regions, named["_n"] == regions["node"]).select(F.col("label").alias("region"), "cls", "n", "set", "member"), "regions")
            before = size
        else:
            turn += 1
            links, rows = _cut(inside, big, limit, turn)
            found.append(links)
        discard(inside)
        release(spark)
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    # only the few regions that several tasks share are joined, so no set moves for that
    parts = F.ceil(F.col("weight") / F.lit(4 * limit))
    shared = materialize(_sizes(rows).select(F.col("region").alias("_r"), parts.alias("salts")).filter("salts > 1"), "shared")
    rows = rows.join(shared, rows["region"] == shared["_r"], "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long")))
    # members go to every part of their region, the others to one
    mine = F.when(F.col("member"), F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cls"), F.col("salts"))))
    rows = rows.withColumn("_part", F.explode(mine)).withColumn("region", F.xxhash64("region", "_part"))
    weight = int(rows.agg(F.sum("n")).first()[0] or 0)
    tasks = max(16, weight // TASK_SHINGLES)
    links = rows.select("region", "cls", "set", "member", F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("_task")).groupBy("_task").applyInArrow(_solve, "a binary, b binary")
    for x in found:
        links = links.unionByName(x)
    links = materialize(links, "links")
    for x in done:
        discard(x)
    release(spark)
    return links, bool(found)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.md5(text_or_empty(F.col("text")))).alias("name"), "text")


def _labelled(docs: DataFrame, region_limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, name, n, cls), and of each class that links (cls, label)."""
    docs = _rows(docs)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("name binary, n long, cls binary, chunk int, counts binary")])
    scan = materialize(docs.mapInArrow(_scan, schema), "shingles")
    slim = scan.filter("chunk is null").select("doc_id", "name", "n", "cls")
    total = int(scan.agg(F.sum("n")).first()[0] or 0)
    regions = _regions(docs, "text", scan.select("chunk", "counts"), total)
    of = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "name"))
    reps = slim.filter("cls is not null").groupBy("cls").agg(of.alias("_x"), F.min("n").alias("n")).withColumn("_n", _node())
    reps = reps.join(regions, reps["_n"] == regions["node"]).select(F.col("label").alias("region"), "cls", "n", F.col("_x.doc_id").alias("doc_id"), F.col("_x.name").alias("name"))
    rows = docs.join(reps, null_safe(docs, reps, ["doc_id", "name"])).select("region", "cls", "n", "text")
    release(docs.sparkSession)
    sets = materialize(rows.mapInArrow(_sets, ROWS), "sets")
    del rows, reps, regions
    release(docs.sparkSession)
    links, edges = _joined(sets, region_limit)
    if edges:
        links = components(links).select(F.col("node").alias("a"), F.col("label").alias("b"))
    # a component's name is a class that stands only on the right
    return slim, links.filter("a <> b").select(F.col("a").alias("cls"), F.col("b").alias("label"))


def classify(docs: DataFrame, region_limit: int = REGION_LIMIT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    slim, links = _labelled(docs, region_limit)
    # by class first: copies of one text meet as one number
    least = slim.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = least.join(links, "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    whole = named.groupBy("label").agg(F.min("least").alias("component"))
    classes = named.join(whole, "label").select(F.col("cls").alias("_c"), "component")
    return slim.join(classes, slim["cls"] == classes["_c"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, region_limit: int = REGION_LIMIT) -> DataFrame:
    """Of each component one row, with all columns of ``docs``; rows without words stay."""
    slim, links = _labelled(docs, region_limit)
    # rows that repeat id and text are counted, so that only they need to meet with their texts
    alike = slim.groupBy("doc_id", "name", "cls").agg(F.count("*").alias("_many"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_kept_id"), F.col("name").alias("_kept_name"), "_many"))
    best = alike.filter("cls is not null").groupBy("cls").agg(first.alias("_b")).join(links, "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("_b").alias("_b"))
    best = best.select("_b._kept_id", "_b._kept_name", (F.col("_b._many") > 1).alias("_kept_once"))
    empty = alike.filter("cls is null").select(F.col("doc_id").alias("_kept_id"), F.col("name").alias("_kept_name"), F.lit(False).alias("_kept_once"))
    chosen = materialize(best.unionByName(empty), "kept")
    name = F.unhex(F.md5(text_or_empty(docs["text"])))
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_kept_id"]) & (name == chosen["_kept_name"])).select(*[docs[c] for c in docs.columns], "_kept_once", "_kept_name")
    once = kept.filter("_kept_once").dropDuplicates(["doc_id", "_kept_name"])
    return kept.filter("not _kept_once").unionByName(once).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return classify(table(spark, sf_dir, "documents"))
