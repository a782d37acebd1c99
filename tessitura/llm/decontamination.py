"""Benchmark decontamination by latent semantic retrieval (operator 5).

1. Words (A-Z lower-cased, ASCII punctuation is space) are hashed to ``FEATURES`` features;
   document frequencies are counted over all documents.
2. Passages are blocks of 64 words; their TF-IDF rows A are never stored. The range finder of
   the randomised SVD takes one pass, Y = A'(A R) with a random R, summed over tasks in pieces; its
   orthonormal basis Q is made on the driver (FEATURES x RANK numbers, whatever the corpus).
   A second pass sums (A Q)'(A Q), whose eigenvectors give the right singular vectors. All
   passages of all documents enter both.
3. Every window of about an item's length, at every 16th word, is compared with every item by
   cosine of the centred latent vectors scaled to unit variance, in blocks of items. Items of fewer words than 16
   are compared with windows of their own length, at every quarter of it (at every word for less than eight words).
   Windows above ``min_cosine``, for short items above half of it, are candidates.
4. A candidate is checked on words, in the window and half an item and 16 words on both sides (a short item's in a quarter): the longest
   common subsequence must have ``min_share`` of the item's words, and where it has less than
   ``sure_share`` the answer, the item's last ``ANSWER`` words, must be there for the greater part.
   Before the subsequence is found, candidates go whose words can't reach it: the item's places
   whose word stands anywhere in the window are an upper bound of it (words by an 11-bit hash,
   which only raises the bound); for short items a like bound goes before the cosine. Nothing else decides what is checked.

The result has a row for each (document, item) that passes, the best place of each.

Defined cases: a null or wordless text or item matches nothing; rows that repeat a ``doc_id``, null
among them, are one document, whose best place is reported; ``keep_clean`` judges rows by their
text alone, so it keeps a clean row whatever its id; items that repeat an id are separate
questions, the best of them is reported; an empty table of either kind gives no rows; other
columns are not touched, and ids keep their type.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shingle import byte_table, hash_words, parts
from tessitura.session import materialize

FEATURE_BITS, SIGN_BITS = 13, 11
FEATURES, SIGNS, RANK, BLOCK, PASSAGE = 1 << FEATURE_BITS, 1 << SIGN_BITS, 96, 16, 64
ANSWER = 5
ITEM_BLOCK = 4096
ROWS = 128  # of Y in one piece
SALTS = 1024
#: Words that are laid out at once, and that are added up at once (so that they stay in a core's cache).
LAID, CACHED = 1 << 18, 1 << 12
_SPACED = byte_table(string.punctuation + " \t\n\v\f\r")


def features(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - FEATURE_BITS)).astype(np.uint16)


def lay_out(ids: np.ndarray, ends: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of many texts, each padded to whole units of words by the feature FEATURES; the unit in which each text starts."""
    sizes = np.diff(ends)
    first = np.r_[0, np.cumsum(-(-sizes // unit))]
    out = np.full(first[-1] * unit, FEATURES, np.uint16)
    out[np.arange(ends[0], ends[-1]) - ends[0] + np.repeat(first[:-1] * unit - (ends[:-1] - ends[0]), sizes)] = ids
    return out, first


def unit_sums(table: np.ndarray, laid: np.ndarray, unit: int) -> np.ndarray:
    """Sums over units of the table's rows (the last row, of the padding, is zero)."""
    out = np.empty((len(laid) // unit, table.shape[1]), np.float32)
    for a in range(0, len(laid), CACHED):
        rows = np.take(table, laid[a : a + CACHED], axis=0, mode="clip")
        rows.reshape(-1, unit, table.shape[1]).sum(1, out=out[a // unit : (a + len(rows)) // unit])
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    return np.vstack([table, np.zeros((1, table.shape[1]))]).astype(np.float32)


def _tokens(batches):
    """Features of the texts, laid out in passages, then the task's document frequencies."""
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in parts(batches):
        words, ends = hash_words(batch.column("text"), _SPACED)
        ids = features(words)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b > a:
                seen = np.zeros(FEATURES, bool)
                seen[ids[a:b]] = True
                df += seen
                n += 1
        laid, _ = lay_out(ids, ends, PASSAGE)
        blobs = [laid[a : a + LAID].tobytes() for a in range(0, len(laid), LAID)]
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], names=["ids", "df"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([np.r_[df, n].tobytes()], pa.binary())], names=["ids", "df"])


def _adder(kind):
    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("v").to_pylist():
            a = np.frombuffer(blob, kind).astype(np.float64 if kind is not np.int64 else np.int64)
            total = a if total is None else total + a
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "v": pa.array([total.astype(kind).tobytes()], pa.binary())})

    return add


def _summed(rows: DataFrame, kind) -> dict[int, np.ndarray]:
    """Sums of equal pieces (piece, v), first over salts; as many rows come as there are pieces."""
    ddl = "piece int, salt int, v binary"
    rows = rows.select("piece", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"), "v")
    rows = rows.groupBy("piece", "salt").applyInArrow(_adder(kind), ddl).groupBy("piece").applyInArrow(_adder(kind), ddl)
    return {r["piece"]: np.frombuffer(r["v"], kind) for r in rows.select("piece", "v").collect()}


def _laid(batches):
    """The passages of the task, some LAID words at a time."""
    held, size = [], 0
    for batch in batches:
        for blob in batch.column("ids").to_pylist():
            held.append(np.frombuffer(blob, np.uint16))
            size += len(held[-1])
            if size >= LAID:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def back_product(y: np.ndarray, laid: np.ndarray, weighted: np.ndarray, weight: np.ndarray) -> None:
    """Adds A'(A R) of some passages, rows of unit length, to y (without its factor idf); ``weighted`` is idf R."""
    rank, group = y.shape[1], 8
    rows = unit_sums(weighted, laid, PASSAGE)
    order = np.argsort(laid, kind="stable")
    order = order[: len(order) - int((laid == FEATURES).sum())]
    feature, passage = laid[order], order // PASSAGE
    fresh = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (passage[1:] != passage[:-1])][: len(order)])
    x = np.diff(np.r_[fresh, len(order)]) * weight[feature[fresh]]
    rows /= np.maximum(np.bincount(passage[fresh], x * x, len(rows)), 1e-6)[:, None].astype(np.float32)
    # places by feature, each feature's padded to whole groups of a row of zeros
    cuts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]][: len(order)])
    sizes = np.diff(np.r_[cuts, len(order)])
    groups = -(-sizes // group)
    begin = np.cumsum(groups) - groups
    index = np.full(int(groups.sum()) * group, len(rows), np.int64)
    index[np.arange(len(order)) + np.repeat(begin * group - cuts, sizes)] = passage
    rows = np.vstack([rows, np.zeros((1, rank), np.float32)])
    parts = np.empty((len(index) // group, rank), np.float32)
    for a in range(0, len(index), CACHED):
        taken = np.take(rows, index[a : a + CACHED], axis=0, mode="clip")
        taken.reshape(-1, group, rank).sum(1, out=parts[a // group : (a + len(taken)) // group])
    if len(cuts):
        y[feature[cuts]] += np.add.reduceat(parts, begin, axis=0)


def _range(idf, rank: int, seed: int):
    """A'(A R): passages' rows scaled to unit length."""

    def run(batches):
        w = idf.value.astype(np.float32)
        weighted = _padded(np.random.default_rng(seed).standard_normal((FEATURES, rank)) * w[:, None])
        y = np.zeros((FEATURES, rank), np.float32)
        for laid in _laid(batches):
            back_product(y, laid, weighted, w)
        pieces = (y * w[:, None]).reshape(-1, ROWS * rank)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "v"])

    return run


def _moments(basis):
    """(A Q)'(A Q), the sum of A Q, the number of passages and of words."""

    def run(batches):
        q = _padded(basis.value)
        k = q.shape[1]
        c, m, n, words = np.zeros((k, k)), np.zeros(k), 0, 0.0
        for laid in _laid(batches):
            b = unit_sums(q, laid, PASSAGE)
            c += b.T @ b
            m += b.sum(0)
            n += len(b)
            words += float((laid < FEATURES).sum())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.r_[c.ravel(), m, float(n), words].tobytes()], pa.binary())], names=["piece", "v"])

    return run


class Latent:
    """The latent space: projection of weighted features to unit variance, mean of a block."""

    def __init__(self, idf: np.ndarray, projection: np.ndarray, mean: np.ndarray):
        self.weighted, self.mean = _padded(projection * idf[:, None]), mean.astype(np.float32)

    def blocks(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent vectors of the blocks of many texts, and the block in which each text starts."""
        laid, first = lay_out(ids, ends, BLOCK)
        words = (laid.reshape(-1, BLOCK) < FEATURES).sum(1)
        return unit_sums(self.weighted, laid, BLOCK) - self.mean * (words / BLOCK)[:, None].astype(np.float32), first


def fit(docs: DataFrame, rank: int = RANK, seed: int = 5) -> Latent:
    """Learns the space from all documents."""
    sc = docs.sparkSession.sparkContext
    tokens = materialize(docs.select("text").mapInArrow(_tokens, "ids binary, df binary"), "features")
    df = _summed(tokens.filter("df is not null").select(F.lit(0).alias("piece"), F.col("df").alias("v")), np.int64).get(0, np.zeros(FEATURES + 1, np.int64))
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1]))
    tokens = tokens.filter("ids is not null").select("ids")
    y = _summed(tokens.mapInArrow(_range(sc.broadcast(idf), rank, seed), "piece int, v binary"), np.float32)
    if not y:
        return Latent(idf, np.zeros((FEATURES, rank)), np.zeros(rank))
    basis, _ = np.linalg.qr(np.concatenate([y[i] for i in sorted(y)]).reshape(FEATURES, rank).astype(np.float64))
    sums = _summed(tokens.mapInArrow(_moments(sc.broadcast(basis * idf[:, None])), "piece int, v binary"), np.float64)[0]
    n, total = max(sums[-2], 1.0), sums[rank * rank : -2]
    mean = total / n
    values, vectors = np.linalg.eigh(sums[: rank * rank].reshape(rank, rank) / n - np.outer(mean, mean))
    scale = np.where(values > 1e-9 * max(values.max(), 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)
    turn = vectors * scale
    return Latent(idf, basis @ turn, total @ turn * (BLOCK / max(sums[-1], 1.0)))


def places(item: list[int]) -> dict[int, int]:
    """For each word the bits of its places in the item."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(at: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words, a bit for each of them."""
    full = (1 << n) - 1
    v = full
    for w in text:
        m = at.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Items:
    """A block of items (ids of any type, texts), ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None], latent: Latent):
        words, ends = hash_words(pa.array(texts, pa.string()), _SPACED)
        full = np.flatnonzero(np.diff(ends))
        self.ids = [ids[i] for i in full.tolist()]
        self.words = [words[ends[i] : ends[i + 1]] for i in full.tolist()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        blocks, first = latent.blocks(features(words), ends)
        vectors = np.array([blocks[first[i] : first[i + 1]].sum(0) for i in full.tolist()], np.float32).reshape(len(full), blocks.shape[1])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        units = np.where(self.size < BLOCK, np.maximum(1, self.size // 4), BLOCK)
        spans = np.where(units < BLOCK, -(-self.size // units), np.round(self.size / BLOCK).astype(np.int64))
        self.by_unit = {int(u): {int(m): np.flatnonzero((units == u) & (spans == m)) for m in np.unique(spans[units == u])} for u in np.unique(units)}
        self.counts = np.zeros((len(full), SIGNS), np.uint16)  # places of each item by the hash of their word
        for i, w in enumerate(self.words):
            np.add.at(self.counts[i], (w >> np.uint64(64 - SIGN_BITS)).astype(np.int64), 1)
        self.at = [places(w.tolist()) for w in self.words]
        self.answer = [w[-ANSWER:].tolist() for w in self.words]
        self.answer_at = [places(a) for a in self.answer]


class Search:
    """Finds the items in texts."""

    def __init__(self, latent: Latent, items: Items, min_share: float, sure_share: float, min_cosine: float):
        self.latent, self.items = latent, items
        self.min_share, self.sure_share, self.min_cosine = min_share, sure_share, min_cosine

    def candidates(self, ids: np.ndarray, ends: np.ndarray):
        """(unit, text, first word in the text, item, cosine) of the windows near an item, which begin at every unit of words."""
        for unit, by_span in self.items.by_unit.items():
            if unit < BLOCK:
                for span, which in by_span.items():
                    yield from self.short(ids, ends, unit, span, which)
                continue
            blocks, first = self.latent.blocks(ids, ends)
            text = np.repeat(np.arange(len(ends) - 1), np.diff(first))
            sums = np.vstack([np.zeros((1, blocks.shape[1])), np.cumsum(blocks, axis=0, dtype=np.float64)])
            for span, which in by_span.items():
                for a in range(0, len(blocks), CACHED):
                    at = np.arange(a, min(a + CACHED, len(blocks)))
                    w = (sums[np.minimum(at + span, first[text[at] + 1])] - sums[at]).astype(np.float32)
                    row, column, cosine = self.near(w, which, self.min_cosine)
                    yield unit, text[at[row]], (at[row] - first[text[at[row]]]) * unit, column, cosine

    def near(self, w: np.ndarray, which: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, cosine) of the rows of w whose cosine with one of the items is ``least`` or more."""
        norm = np.sqrt(np.einsum("ij,ij->i", w, w))
        dot = w @ self.items.vectors[which].T
        row, column = np.nonzero(dot >= np.maximum(least * norm, 1e-9)[:, None])
        return row, which[column], dot[row, column] / norm[row]

    def short(self, ids: np.ndarray, ends: np.ndarray, unit: int, span: int, which: np.ndarray):
        """``candidates`` of items shorter than a block.

        Left out are windows around which fewer words than the least subsequence belong to any of the items, as no check could pass there.
        """
        sizes = self.items.size[which]
        around = int(sizes.max()) // 4 + unit - 1
        least = int(np.ceil(self.min_share * sizes.min() - 1e-6))
        member = np.zeros(FEATURES + 1, bool)
        for i in which.tolist():
            member[features(self.items.words[i])] = True
        upto = np.r_[0, np.cumsum(member[ids])]
        first = np.r_[0, np.cumsum(-(-np.diff(ends) // unit))]
        text = np.repeat(np.arange(len(ends) - 1), np.diff(first))
        at = ends[text] + (np.arange(first[-1]) - first[text]) * unit
        lo, hi = np.maximum(ends[text], at - around), np.minimum(ends[text + 1], at + unit * span + around)
        live = np.flatnonzero(upto[hi] - upto[lo] >= least)
        step = max(1, CACHED // (unit * span))
        for a in range(0, len(live), step):
            k = live[a : a + step]
            places = at[k, None] + np.arange(unit * span)
            inside = places < ends[text[k] + 1][:, None]
            rows = self.latent.weighted[np.where(inside, ids[np.minimum(places, len(ids) - 1)], FEATURES)]
            w = rows.sum(1) - self.latent.mean * (inside.sum(1) / BLOCK)[:, None].astype(np.float32)
            row, column, cosine = self.near(w, which, self.min_cosine / 2)
            yield unit, text[k[row]], at[k[row]] - ends[text[k[row]]], column, cosine

    def hits(self, words: np.ndarray, ends: np.ndarray):
        """(text, item, share, cosine, first word of the window, answer found) of all that pass."""
        ends = ends - ends[0]
        sign = (words >> np.uint64(64 - SIGN_BITS)).astype(np.int64)
        order = np.argsort(sign.astype(np.uint16), kind="stable")
        same = np.flatnonzero(sign[order][1:] == sign[order][:-1])
        before = np.full(len(words), -1, np.int64)  # the last place of the same sign
        before[order[same + 1]] = order[same]
        for unit, text, at, item, cosine in self.candidates(features(words), ends):
            n = self.items.size[item]
            # a window lies within a unit of where the item does
            around = n // 2 + BLOCK if unit == BLOCK else n // 4 + unit - 1
            lo = np.maximum(ends[text], ends[text] + at - around)
            hi = np.minimum(ends[text + 1], ends[text] + at + n + around)
            able = np.flatnonzero(self.bound(sign, before, lo, hi, item) >= self.min_share * n - 1e-6) if len(item) else item
            for k in able.tolist():
                i, m = int(item[k]), int(n[k])
                near_by = words[lo[k] : hi[k]].tolist()
                share = lcs(self.items.at[i], m, near_by) / m
                if share < self.min_share - 1e-9:
                    continue
                answer = self.items.answer[i]
                found = 2 * lcs(self.items.answer_at[i], len(answer), near_by) > len(answer)
                if share >= self.sure_share or found:
                    yield int(text[k]), i, share, float(cosine[k]), int(at[k]), found

    def bound(self, sign, before, lo, hi, item) -> np.ndarray:
        """How many of the item's places have their word between lo and hi, at most."""
        wide = int((hi - lo).max())
        out = np.empty(len(lo), np.int64)
        step = max(1, (1 << 18) // max(wide, 1))
        counts = self.items.counts.ravel()
        for a in range(0, len(lo), step):
            low, high = lo[a : a + step, None], hi[a : a + step, None]
            at = np.minimum(low + np.arange(wide), len(sign) - 1)
            first = (before[at] < low) & (low + np.arange(wide) < high)
            out[a : a + step] = (counts[sign[at] + item[a : a + step, None] * SIGNS] * first).sum(1)
        return out


def _search(latent, items, shares: tuple[float, float, float], schema: pa.Schema):
    def run(batches):
        search = Search(latent.value, items.value, *shares)
        found = search.items
        for batch in parts(batches):
            words, ends = hash_words(batch.column("text"), _SPACED)
            out, a = [], 0
            while a < len(ends) - 1 and found.ids:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + CACHED * BLOCK)) - 1)
                out += [(t + a, *rest) for t, *rest in search.hits(words[ends[a] : ends[b]], ends[a : b + 1])]
                a = b
            text, item, share, cosine, at, answer = zip(*out, strict=True) if out else ([],) * 6
            key = batch.column(0).take(pa.array(text, pa.int64()))
            columns = [key, pa.array([found.ids[i] for i in item], schema.field(1).type), pa.array([round(x, 4) for x in share], pa.float64()), pa.array([round(x, 3) for x in cosine], pa.float64()), pa.array(at, pa.int64()), pa.array(answer, pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, key: str, min_share: float, sure_share: float, min_cosine: float, rank: int) -> DataFrame:
    """(key, item_id, lcs_share, cosine, at_word, answer_found) of all windows that pass, by the column ``key``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sc = docs.sparkSession.sparkContext
    out = StructType.fromDDL("lcs_share double, cosine double, at_word long, answer_found boolean")
    ddl = StructType([docs.schema[key], benchmark.schema["item_id"], *out])
    schema = to_arrow_schema(ddl)
    latent = fit(docs, rank)
    held = sc.broadcast(latent)
    parts, rows = [], []

    def search():
        items = Items([r[0] for r in rows], [r[1] for r in rows], latent)
        return docs.select(key, "text").mapInArrow(_search(held, sc.broadcast(items), (min_share, sure_share, min_cosine), schema), ddl)

    for r in benchmark.select("item_id", "text").toLocalIterator():  # the query set, in blocks
        rows.append(r)
        if len(rows) == ITEM_BLOCK:
            parts.append(search())
            rows = []
    if rows or not parts:
        parts.append(search())
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.6, sure_share: float = 0.9, min_cosine: float = 0.25, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine, at_word, answer_found) of the documents that hold an item."""
    found = _found(docs, benchmark, "doc_id", min_share, sure_share, min_cosine, rank)
    place = F.struct("lcs_share", "cosine", -F.col("at_word"))
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("lcs_share", "cosine", "at_word", "answer_found"), place).alias("_b")).select("doc_id", "item_id", "_b.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.6, sure_share: float = 0.9, min_cosine: float = 0.25, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` in which no item was found, with all their columns."""
    name = F.unhex(F.md5("text"))
    bad = _found(docs.select(name.alias("_name"), "text"), benchmark, "_name", min_share, sure_share, min_cosine, rank).select("_name").distinct()
    return docs.join(bad, F.unhex(F.md5(docs["text"])) == bad["_name"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
