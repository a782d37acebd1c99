"""Removal of repeated byte strings by sorted suffixes (operator 6).

Every byte that lies in a string of ``LENGTH`` = 200 bytes which also starts elsewhere in the
corpus goes. The suffixes are sorted deep-shallow, on a sparse set of anchors:

* A window of 200 bytes has one anchor: the place of its least 64-byte string by hash. Equal
  windows have their anchors at the same offset, so only suffixes at anchors, about one in 70
  bytes, need order, and the windows of one anchor are a run of starts.
* Shallow: Spark deals anchors by the hash of their first 64 bytes; each task sorts its suffixes by
  multikey quicksort to that depth. Suffixes that differ there repeat nothing.
  Anchors whose whole context (all bytes of all their windows) is equal are settled: every window
  repeats. Before the shuffle each task does this to its own anchors and sends one of each
  context, so a passage in a third of all texts costs a row for each task.
* Deep: the groups that are left have a common prefix of 64 bytes. A blind trie (branch bytes
  only, one comparison with a leaf for each insertion) orders their contexts to the right;
  along the trie the orders of the contexts to the left are merged, smaller into larger, and
  neighbours give each window that repeats. Groups of more than ``HOT`` contexts go by each of their
  windows instead, combined in the tasks first.
* A 64-byte string with very many contexts must not meet in one task at all. A first pass counts, for
  strings with several contexts in one task, their contexts; those with more than a millionth of all
  anchors (so fewer than a million strings) are dealt by context, and go on by windows.

Texts, contexts and windows are named by 128-bit hashes.

Equal texts of 200 bytes or more repeat as a whole; one of them stands for all above.
Strings are judged on the input, never on what is left.

Defined cases: a null or empty text has no bytes; texts under 200 bytes lose nothing; repeated
rows are texts that repeat; an empty table gives no rows; other columns are not touched.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tessitura.llm.common import text_or_empty
from tessitura.llm.shingle import mix, pack, texts_of, unpack
from tessitura.session import materialize

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1
HOT = 4096
CHUNK = 1 << 20
#: Parts of a bucket that are sorted whole.
SMALL = 64
#: Texts that a task remembers to have seen.
SEEN = 1 << 20
#: Of the mark of an anchor: it is settled as well; its string is hot.
ALSO_SETTLED, IN_HOT = 1 << 20, 1 << 21
#: Buckets of a shuffle at least, and bytes of text for each.
BUCKETS, BUCKET_BYTES = 256, 32 << 20
#: Bytes of text for an anchor, about, and how many strings may be hot.
ANCHOR_BYTES, MOST_HOT = 70, 1_000_000
_PLACE = np.uint64((1 << 22) - 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25


def _gram_hashes(b: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hash of the ``width`` (a power of two) bytes from each place on."""
    h, step, base = _BYTE[b], 1, _BASE
    while step < width:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base & 0xFFFFFFFFFFFFFFFF, 2 * step
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on."""
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(texts: list[bytes]):
    """Of the texts laid end to end, at most a few MB: (text number, anchor, first start, last start), places inside the text; the anchors' hashes and first GRAM bytes."""
    joined = b"".join(texts)
    if len(joined) < LENGTH:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64), np.empty(0, "S64"))
    b = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(sizes)]
    h = _gram_hashes(b)
    keyed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    owner = (_least(keyed, SPAN) & _PLACE).astype(np.int64)
    starts = np.arange(len(owner))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(owner)]
    fits = starts + LENGTH <= begin[text + 1]
    starts, owner, text = starts[fits], owner[fits], text[fits]
    if not len(starts):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64), np.empty(0, "S64"))
    turn = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    end = np.r_[turn[1:], len(starts)] - 1
    t = text[turn]
    return t, owner[turn] - begin[t], starts[turn] - begin[t], starts[end] - begin[t], h[owner[turn]], np.lib.stride_tricks.sliding_window_view(b, GRAM)[owner[turn]].view("S64").ravel()


def _pieces(rows, chunk: int):
    """Lists of (key, offset, bytes) of about ``chunk`` bytes; a longer text comes in pieces that overlap by 199 bytes."""
    held, size = [], 0
    for key, t in rows:
        for at in range(0, max(1, len(t) - LENGTH + 1), chunk):
            part = t[at : at + chunk + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            held.append((key, at, part))
            size += len(part)
            if size > chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


_A = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("gram", "ctx", "head", "text", "at", "back", "on")])
_B = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("text", "first", "last", "at", "gram", "kind")])
_A_DDL, _B_DDL = (", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in s) for s in (_A, _B))
_TYPES = {"gram": np.uint64, "ctx": "S16", "head": "S64", "text": "S16", "at": np.int64, "back": np.int32, "on": np.int32, "first": np.int64, "last": np.int64, "kind": np.uint8}
#: Of a run of starts: all repeat; to be decided; to be decided window by window.
SETTLED, OPEN, BURST = 1, 2, 4


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [unpack(table.column(c), _TYPES[c]) for c in names]


def _same_context(gram, ctx):
    """Order by (gram, ctx); where a context starts; how many share it (for each row in order)."""
    order = np.lexsort((ctx, gram))
    g, c = gram[order], ctx[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])] if len(g) else np.empty(0, bool)
    count = np.diff(np.r_[np.flatnonzero(new), len(g)])
    return order, new, np.repeat(count, count)


def _texts(batches):
    """The (key, text) that can lose bytes, most of them once."""
    seen: set[bytes] = set()
    for batch in batches:
        for key, t in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), strict=True):
            if t is not None and len(t) >= LENGTH and key not in seen:
                if len(seen) < SEEN:
                    seen.add(key)
                yield key, t


def _anchored(batches, chunk: int, most: int = 1_000_000):
    """Columns (gram, ctx, head, text, at, back, on) of about ``most`` anchors at a time."""
    held, size = [], 0
    for part in _pieces(_texts(batches), chunk):
        bodies = [p for _, _, p in part]
        t, at, first, last, gram, head = anchors(bodies)
        # the place of the anchor in its context is part of the context's name
        ctx = [xxhash.xxh3_128_digest(bodies[i][f : e + LENGTH], (a - f) * 256 + e - f) for i, a, f, e in zip(t.tolist(), at.tolist(), first.tolist(), last.tolist(), strict=True)]
        keys, offsets = np.array([k for k, _, _ in part], "S16"), np.array([o for _, o, _ in part], np.int64)
        held.append((gram, np.array(ctx, "S16"), head, keys[t], at + offsets[t], (at - first).astype(np.int32), (last - first).astype(np.int32)))
        size += len(t)
        if size > most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _crowded(chunk: int, least: int):
    """(gram, contexts) of the strings with several contexts in the task."""

    def run(batches):
        for gram, ctx, *_ in _anchored(batches, chunk):
            order, new, _ = _same_context(gram, ctx)
            g, n = np.unique(gram[order][new], return_counts=True)
            many = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(g[many].view(np.int64)), pa.array(n[many], pa.int64())], names=["gram", "n"])

    return run


def _scan(chunk: int, buckets: int, hot):
    def run(batches):
        """Anchors of the task's texts, one for each context; those that it shares go on as settled (``on`` < 0)."""
        crowded = hot.value
        for gram, ctx, head, text, at, back, on in _anchored(batches, chunk):
            order, new, count = _same_context(gram, ctx)
            gram, ctx, head, text, at, back, on = (x[order] for x in (gram, ctx, head, text, at, back, on))
            found = np.minimum(np.searchsorted(crowded, gram), max(len(crowded) - 1, 0))
            is_hot = (crowded[found] == gram) if len(crowded) else np.zeros(len(gram), bool)
            # the first of each context stands for it; the others only carry their mark
            mark = np.where(new, on + np.where(count > 1, ALSO_SETTLED, 0) + np.where(is_hot, IN_HOT, 0), -1 - on)
            head[~new] = b""
            deal = np.where(is_hot, gram ^ mix(ctx.view(np.uint64)[::2]), gram)
            yield pack((deal % np.uint64(buckets)).astype(np.int32), [gram, ctx, head, text, at, back, mark.astype(np.int32)], _A)

    return run


def multikey(keys: np.ndarray) -> np.ndarray:
    """Order of the strings in the rows of ``keys`` (words of eight bytes, first byte highest) by multikey quicksort.

    A part is split in three about a pivot's word: smaller and larger words stay at this depth, equal
    ones go on with the next word. Small parts are sorted as they are.
    """
    order, todo = np.arange(len(keys)), [(0, len(keys), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == keys.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort(keys[part, depth:].T[::-1])]
            continue
        word = keys[part, depth]
        pivot = np.sort(word[:: max(1, len(word) // 9)])[4]
        less, same, more = part[word < pivot], part[word == pivot], part[word > pivot]
        order[lo:hi] = np.concatenate((less, same, more))
        i, j = lo + len(less), hi - len(more)
        todo += [(lo, i, depth), (i, j, depth + 1), (j, hi, depth)]
    return order


def _by_text(text, rest, buckets: int) -> pa.RecordBatch:
    return pack((mix(np.ascontiguousarray(text).view(np.uint64)[::2]) % np.uint64(buckets)).astype(np.int32), [text, *rest], _B)


def _shallow(hot: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Settles the contexts that are equal; says which anchors the deep sort needs."""
        gram, ctx, head, text, at, back, on = _columns(table, ["gram", "ctx", "head", "text", "at", "back", "on"])
        marked = on < 0
        length = np.where(marked, -1 - on, on & (ALSO_SETTLED - 1)).astype(np.int64)
        settled, crowded = marked | (on & ALSO_SETTLED > 0), ~marked & (on & IN_HOT > 0)
        first = at - back
        kind = np.where(settled, SETTLED, 0).astype(np.uint8)
        rep = np.flatnonzero(~marked)
        words = head[rep].view(np.uint8).reshape(-1, GRAM).view(">u8").astype(np.uint64)
        order = multikey(words)
        rep, words = rep[order], words[order]
        group = np.cumsum(np.r_[True, (words[1:] != words[:-1]).any(1)][: len(rep)])
        alone = np.r_[True, group[1:] != group[:-1]] & np.r_[group[1:] != group[:-1], True] if len(rep) else np.empty(0, bool)
        kept = ~alone | crowded[rep]
        rep, group = rep[kept], group[kept]
        # the same text in several tasks is one place
        order = np.lexsort((first[rep], text[rep], ctx[rep], group))
        rep, group = rep[order], group[order]
        if len(rep):
            same = np.r_[False, (group[1:] == group[:-1]) & (ctx[rep][1:] == ctx[rep][:-1])]
            fresh = ~(same & np.r_[False, (text[rep][1:] == text[rep][:-1]) & (first[rep][1:] == first[rep][:-1])])
            rep, group, new = rep[fresh], group[fresh], ~same[fresh]
            count = np.diff(np.r_[np.flatnonzero(new), len(rep)])
            kind[rep[np.repeat(count, count) > 1]] |= SETTLED
            heads, g = rep[new], group[new]  # one of each context
            fresh = np.r_[True, g[1:] != g[:-1]]
            contexts = np.diff(np.r_[np.flatnonzero(fresh), len(g)])
            undecided = np.add.reduceat((kind[heads] == 0).astype(np.int64), np.flatnonzero(fresh))
            wanted = np.repeat((contexts > 1) & (undecided > 0), contexts) | crowded[heads]
            burst = np.repeat(contexts > hot, contexts) | crowded[heads]
            kind[heads[wanted]] |= np.where(burst[wanted], OPEN | BURST, OPEN).astype(np.uint8)
        out = np.flatnonzero(kind)
        return pa.Table.from_batches([_by_text(text[out], [first[out], (first + length)[out], at[out], gram[out], kind[out]], buckets)], _B)

    return run


def _names(text: np.ndarray) -> list[bytes]:
    """All 16 bytes of each name."""
    return np.ascontiguousarray(text).view("V16").tolist()


def _needs(table: pa.Table) -> pa.Table:
    """One row for each text with anchors to sort: their places."""
    text, first, last, at, gram, kind = _columns(table, ["text", "first", "last", "at", "gram", "kind"])
    here = np.flatnonzero(kind & OPEN)
    here = here[np.lexsort((first[here], text[here]))]
    rows = np.column_stack((first[here], last[here], at[here], gram[here].view(np.int64), kind[here].astype(np.int64)))
    cuts = np.flatnonzero(np.r_[True, text[here][1:] != text[here][:-1]]) if len(here) else np.empty(0, np.int64)
    stops = np.r_[cuts[1:], len(here)] if len(here) else np.empty(0, np.int64)
    return pa.table({"n_key": pa.array(_names(text[here][cuts]), pa.binary()), "places": pa.array([rows[i:j].tobytes() for i, j in zip(cuts, stops, strict=True)], pa.binary())})


_C_DDL = "bucket int, gram long, text binary, at long, first long, last long, body binary"
#: In place of an anchor: one of several starts of equal windows, or the others, which are settled (body: the window's name).
ONE, OTHER = -1, -2


def _contexts(buckets: int):
    def run(batches):
        """The bytes of each anchor's windows; for hot groups a row for each window, one of each content, and settled runs."""
        seen: set[bytes] = set()
        for batch in batches:
            rows, burst = [], {}
            for key, t, places in zip(batch.column("key").to_pylist(), texts_of(batch.column("text")), batch.column("places").to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(key)
                for first, last, at, gram, kind in np.frombuffer(places, np.int64).reshape(-1, 5).tolist():
                    if kind & BURST:
                        for s in range(first, last + 1):
                            burst.setdefault(xxhash.xxh3_128_digest(t[s : s + LENGTH], 7), []).append((key, s))
                    else:
                        rows.append((gram, key, at, first, last, t[first : last + LENGTH]))
            for w, places in burst.items():
                g = int.from_bytes(w[:8], "little", signed=True)
                rows += [(g, k, ONE if n == 0 else OTHER, s, s, w) for n, (k, s) in enumerate(places)]
                if len(places) > 1:
                    rows.append((g, places[0][0], OTHER, places[0][1], places[0][1], w))
            if rows:
                gram, key, at, first, last, body = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([g % buckets for g in gram], pa.int32()), pa.array(gram, pa.int64()), pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in (at, first, last)), pa.array(body, pa.binary())], names=["bucket", "gram", "text", "at", "first", "last", "body"])

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class BlindTrie:
    """Strings by their branching bytes. A node is [depth, {byte: child}]; a leaf is [length, None, string, members]."""

    def __init__(self):
        self.root = None

    def add(self, s: bytes, member) -> None:
        if self.root is None:
            self.root = [len(s), None, s, [member]]
            return
        path, node = [], self.root
        while node[1] is not None:
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        leaf = node[2]
        d = common(s, leaf)
        if d == len(s) == len(leaf):
            node[3].append(member)
            return
        new = [len(s), None, s, [member]]
        parent, at = None, self.root
        while at[1] is not None and at[0] < d:
            parent, at = at, at[1][s[at[0]] if at[0] < len(s) else -1]
        mine = s[d] if d < len(s) else -1
        if at[1] is not None and at[0] == d:
            at[1][mine] = new
            return
        fork = [d, {(leaf[d] if d < len(leaf) else -1): at, mine: new}]
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = fork


def deep(rights: list[bytes], lefts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each context its (left, right) matches with others that no other match covers, and some that are covered."""
    trie = BlindTrie()
    for i, r in enumerate(rights):
        trie.add(r, i)
    order = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = {m: i for i, m in enumerate(order)}
    found: list[list[tuple[int, int]]] = [[] for _ in rights]

    def meet(into: list[int], other: list[int], depth: int) -> list[int]:
        if len(into) < len(other):
            into, other = other, into
        for z in other:
            i = bisect.bisect_left(into, z)
            for y in into[max(0, i - 1) : i + 1]:
                a, b = order[z], order[y]
                m = (common(lefts[a], lefts[b]), depth)
                found[a].append(m)
                found[b].append(m)
            into.insert(i, z)
        return into

    stack, done = [(trie.root, False)], []
    while stack:
        node, visited = stack.pop()
        if node[1] is None:
            ranks: list[int] = []
            for m in node[3]:
                ranks = meet(ranks, [rank[m]], node[0])
            done.append(ranks)
        elif not visited:
            stack.append((node, True))
            stack += [(c, False) for c in node[1].values()]
        else:
            ranks = []
            for _ in node[1]:
                ranks = meet(ranks, done.pop(), node[0])
            done.append(ranks)
    return found


def _deep(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Runs of starts that repeat, of the contexts of one bucket."""
        gram, at, first, last = (table.column(c).to_numpy() for c in ("gram", "at", "first", "last"))
        text, body = table.column("text").to_pylist(), table.column("body").to_pylist()
        names = np.array(text, "S16")
        order = np.lexsort((first, names, at < 0, gram))
        out: list[tuple[bytes, int, int]] = []
        cuts = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
        for i, j in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
            group = order[i:j].tolist()
            places: dict[bytes, set] = {}
            for x in group:
                if at[x] == ONE:
                    places.setdefault(body[x], set()).add((text[x], first[x]))
            out += [(text[x], first[x], last[x]) for x in group if at[x] == OTHER or (at[x] == ONE and len(places[body[x]]) > 1)]
            group = [x for n, x in enumerate(group) if at[x] >= 0 and (n == 0 or (text[x], first[x]) != (text[group[n - 1]], first[group[n - 1]]))]
            if len(group) < 2:
                continue
            rights = [body[x][at[x] - first[x] :] for x in group]
            lefts = [body[x][: at[x] - first[x]][::-1] for x in group]
            if len(group) == 2:
                m = [(common(*lefts), common(*rights))]
                matches = [m, m]
            else:
                matches = deep(rights, lefts)
            for x, ms in zip(group, matches, strict=True):
                for left, right in ms:
                    if left >= LENGTH - right:
                        lo, hi = max(first[x], at[x] - left), min(last[x], at[x] - (LENGTH - right))
                        if lo <= hi:
                            out.append((text[x], lo, hi))
        t, lo, hi = zip(*out, strict=True) if out else ((), (), ())
        t, lo, hi, n = np.array(t, "S16"), np.array(lo, np.int64), np.array(hi, np.int64), len(t)
        return pa.Table.from_batches([_by_text(t, [lo, hi, lo, np.zeros(n, np.uint64), np.full(n, SETTLED, np.uint8)], buckets)], _B)

    return run


def _marks(table: pa.Table) -> pa.Table:
    """One row for each text with repeats: its removed spans, [start, end), sorted and apart."""
    text, first, last, kind = _columns(table, ["text", "first", "last", "kind"])
    here = np.flatnonzero(kind & SETTLED)
    here = here[np.lexsort((first[here], text[here]))]
    text, lo, hi = text[here], first[here], last[here] + LENGTH
    keys, blobs = [], []
    cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
    for i, j in zip(cuts, np.r_[cuts[1:], len(text)] if len(text) else cuts, strict=True):
        a, reach = lo[i:j], np.maximum.accumulate(hi[i:j])
        new = np.r_[True, a[1:] > reach[:-1]]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(a)] - 1
        keys.append(i)
        blobs.append(np.column_stack((a[begin], reach[end])).tobytes())
    return pa.table({"m_key": pa.array(_names(text[keys]), pa.binary()), "spans": pa.array(blobs, pa.binary())})


OUT = StructType([*(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """What is left of a text."""
    at, left = 0, []
    for a, b in spans.tolist():
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]])


def _removed(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, t, spans, copies in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("spans").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                t = t or b""
                s = np.array([[0, len(t)]]) if copies else np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                left = cut(t, s)
                rows.append((doc, len(t), len(t) - len(left), len(s), hashlib.sha256(left).hexdigest(), left))
            _, *values = zip(*rows, strict=True) if rows else ([],) * 6
            values = [pa.array(x, t) for x, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["doc_id", *OUT.fieldNames()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values][: len(names) - (not with_text)], names=names[: len(names) - (not with_text)])

    return run


def remove(docs: DataFrame, with_text: bool = False, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) what was removed; ``with_text`` adds the remaining bytes as ``kept``."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", F.unhex(F.md5(text_or_empty(F.col("text")))).alias("key"))
    size = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    buckets = max(BUCKETS, size // BUCKET_BYTES)
    texts = docs.select("key", "text")
    # fewer than a million strings pass, whatever the size
    crowded = texts.mapInArrow(_crowded(chunk, min(4, hot)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > max(hot, size // ANCHOR_BYTES // MOST_HOT)).select("gram")
    crowded = sc.broadcast(np.sort(np.array([r[0] for r in crowded.collect()], np.int64).view(np.uint64)))
    shallow = texts.mapInArrow(_scan(chunk, buckets, crowded), _A_DDL).groupBy("bucket").applyInArrow(_shallow(hot, buckets), _B_DDL)
    shallow = materialize(shallow, "anchors")
    needs = shallow.groupBy("bucket").applyInArrow(_needs, "n_key binary, places binary")
    # one row of each text, so that copies don't meet
    one = docs.filter(F.octet_length("text") >= LENGTH).groupBy(F.col("key").alias("_key")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_id"))).alias("_one"), F.count("*").alias("copies"))
    one = materialize(one.select("_key", "_one._id", "copies"), "texts")
    wanted = needs.join(one, needs["n_key"] == one["_key"]).select("_key", "_id", "places")
    asked = docs.join(wanted, (docs["key"] == wanted["_key"]) & docs["doc_id"].eqNullSafe(wanted["_id"])).select("key", "text", "places")
    found = asked.mapInArrow(_contexts(buckets), _C_DDL).groupBy("bucket").applyInArrow(_deep(buckets), _B_DDL)
    marks = shallow.unionByName(found).groupBy("bucket").applyInArrow(_marks, "m_key binary, spans binary")
    copies = one.filter("copies > 1").select(F.col("_key").alias("c_key"), "copies")
    all_marks = marks.join(copies, marks["m_key"] == copies["c_key"], "full_outer").select(F.coalesce("m_key", "c_key").alias("m_key"), "spans", "copies")
    marked = docs.join(materialize(all_marks, "marks"), docs["key"] == F.col("m_key"), "left").select("doc_id", "text", "spans", "copies")
    out = StructType([docs.schema["doc_id"], *(OUT.fields if with_text else OUT.fields[:-1])])
    return marked.mapInArrow(_removed(with_text), out)


def query(spark, sf_dir: str) -> DataFrame:
    from tessitura.session import table

    return remove(table(spark, sf_dir, "documents"))
