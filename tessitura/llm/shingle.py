"""Hashed words and shingles of Arrow columns; packing of arrays into rows for a shuffle.

Words are hashed where they lie in the column's buffer, many texts at once: a word's hash is a
polynomial in its bytes modulo 2^64, read off a running sum, and finalised. Texts of any
length go through in pieces that end between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd constants of the standard 64-bit finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_BASE = 0x9FB21C651E98DF25
_PIECE = 1 << 16
#: A byte that UTF-8 never uses stands for NUL, which is a character of a word.
_NUL = 0xC0


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def byte_table(separators: str = " \t\n\v\f\r") -> bytes:
    """For bytes.translate: A-Z lower-cased, separators to 0."""
    table = bytearray(range(256))
    table[0] = _NUL
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in separators:
        table[ord(c)] = 0
    return bytes(table)


PLAIN = byte_table()


def _powers(base: int, n: int) -> np.ndarray:
    out, done, step = np.ones(n, np.uint64), 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & 0xFFFFFFFFFFFFFFFF
    return out


_UP, _DOWN = (_powers(b, _PIECE + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def texts_of(column: pa.Array) -> list:
    """Bytes of each text; null stays None."""
    return column.cast(pa.large_binary()).to_pylist()


def hash_words(column, table: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column's texts one after the other, and where each text starts (one more at the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    begin = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data, hashes, places = memoryview(data), [], []
    at, end = int(begin[0]), int(begin[-1])
    while at < end:
        size = _PIECE
        while True:  # a piece ends after a separator, or with the data
            raw = bytes(data[at : min(at + size, end)]).translate(table)
            if at + size >= end:
                break
            cut = raw.rfind(0)
            if cut >= 0:
                raw = raw[: cut + 1]
                break
            size *= 2
        part = np.frombuffer(raw, np.uint8)
        worded = np.zeros(len(part) + 2, bool)
        np.not_equal(part, 0, out=worded[1:-1])
        turns = np.flatnonzero(worded[1:] != worded[:-1])
        first, last = turns[::2], turns[1::2]
        borders = begin[np.searchsorted(begin, at, side="right") : np.searchsorted(begin, at + len(part))] - at
        borders = np.unique(borders[worded[borders] & worded[borders + 1]])  # two texts meet within a run of word bytes
        if len(borders):
            first, last = np.sort(np.concatenate((first, borders))), np.sort(np.concatenate((last, borders)))
        up, down = (_UP, _DOWN) if len(part) <= _PIECE else (_powers(_BASE, len(part)), _powers(pow(_BASE, -1, 1 << 64), len(part)))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first]))
        places.append(first + at)
        at += len(part)
    places = np.concatenate(places) if places else np.empty(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.searchsorted(places, begin)


def parts(batches, most: int = 4 << 20):
    """The batches in slices with about ``most`` bytes of text each, so that what is made of them stays small."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(sizes.astype(np.int64)), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def windows(words: np.ndarray, k: int, block: int = 1 << 14) -> np.ndarray:
    """Hash of the k words from each place on."""
    n = len(words) - k + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, block):
        m = min(block, n - a)
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = mix(h + words[a + i : a + i + m] + np.uint64((_STEP * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        out[a : a + m] = h
    return out


def shingle_sets(column, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; with fewer words the whole sequence is one."""
    words, ends = hash_words(column)
    all_windows, out = windows(words, k), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(all_windows[a : b - k + 1]))
        elif n:
            out.append(windows(words[a:b], n) ^ np.uint64(n))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return xxhash.xxh3_128_digest(s.tobytes())


def pack(bucket: np.ndarray, arrays: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One row for each bucket: the bucket and, of each array, the bytes of its elements there."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    stops = np.r_[starts[1:], len(bucket)][: len(starts)]
    columns = [pa.array(bucket[starts], schema.field(0).type)]
    for a in arrays:
        a = np.ascontiguousarray(a[order])
        columns.append(pa.array([a[i:j].tobytes() for i, j in zip(starts, stops, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def unpack(column, kind) -> np.ndarray:
    """The elements of all blobs of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)
