"""Finding repeated stretches of a corpus through shared anchors.

A stretch of ``length`` units (bytes or words) is found by an anchor: a place in it that its
own content picks, so equal stretches have equal anchors at equal offsets. Four exchanges:

1. anchor hashes, by hash: which anchors occur again;
2. those anchors and the texts, by document: cut out the context of each shared anchor;
3. contexts, by hash: compare them in a common-prefix interval tree, give the spans to remove;
4. spans and texts, by document: the result.

Before each exchange a task combines what it has: an anchor that it sees twice is known to be
shared, and equal contexts are resolved on the spot, so a hot passage sends a row per task.
Rows of an exchange are compressed column blocks, one for each bucket of each task's share.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import materialize, with_groups

# Kinds of rows; within a bucket they arrive in this order.
HASHES, ANCHORS, SPANS, CONTEXTS, TEXTS = 0, 1, 2, 3, 4
BLOCK = "bucket int, kind int, payload binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
#: Anchors, contexts and text bytes that a task combines before it sends them on.
MOST_ANCHORS, MOST_CONTEXTS, MOST_BYTES = 1_500_000, 250_000, 16_000_000
#: Parts of a block of contexts, by hash: a task unpacks and compares one part of all its blocks at a time.
PARTS = 8
#: Contexts of one anchor that are compared pair by pair, at most, and such pairs at a time; more go through their interval tree.
PAIRED, MOST_PAIRS = 64, 20_000
#: Bits of an anchor's hash that travel; anchors that share a hash by chance are told apart by their contexts.
HASH_BITS = np.uint64((1 << 48) - 1)
#: Text bytes whose anchors are found at once.
ANCHOR_BYTES = 2_000_000
#: An id that sorts after all others: rows without one.
NO_ID = (1 << 63) - 1
#: The end of a span that covers whatever the document has.
WHOLE = (1 << 31) - 1


@dataclass(frozen=True)
class Units:
    """What a repeat is made of.

    ``anchors(texts)`` gives text numbers, hashes, positions, and how many units before and from
    each position a stretch that picks it may reach. ``cut(text)`` gives the text's units for ``context`` and
    ``keep``; ``context(units, a, b)`` joins units, ``split(context)`` is its inverse, and
    ``within_document`` tells whether an earlier place in the same document counts.
    """

    length: int
    anchors: Callable[[list[bytes]], tuple[np.ndarray, ...]]
    cut: Callable[[bytes], bytes | list[bytes]]
    context: Callable
    split: Callable[[list[bytes]], list[np.ndarray]]
    keep: Callable
    within_document: bool


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block. Bytes of equal weight lie together, so small numbers and sorted ones take little room."""
    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def thaw(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<i", raw)
    at, out = 4 + 10 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<2sq", raw, 4 + 10 * k)
        width = int(kind[1:])
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * width, offset=at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{kind.decode()}"))
        at += size * width
    return out


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], schema=_SCHEMA)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(x.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _doc_bucket(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tags.view(np.uint64), buckets)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket) == 0:
        return
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _send(kind: int, bucket: np.ndarray, ids: np.ndarray, tags: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of rows by bucket; documents' ids and tags go to a table, rows name its lines."""
    for b, at in _by_bucket(bucket):
        order = np.lexsort((tags[at], ids[at]))
        i, t = ids[at][order], tags[at][order]
        new = np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])]
        line = np.empty(len(at), dtype=np.int32)
        line[order] = np.cumsum(new) - 1
        yield b, kind, freeze(i[new], t[new], line, *(c[at] for c in columns))


def _receive(payload: bytes) -> list[np.ndarray]:
    ids, tags, line, *columns = thaw(payload)
    return [ids[line], tags[line], *columns]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), batch["payload"], strict=True)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    from itertools import groupby

    for bucket, rows in groupby(_buckets_of(batches), key=lambda r: r[0]):
        yield bucket, ((kind, payload.as_py()) for _, kind, payload in rows)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        texts = batch["_text"].cast(pa.large_binary())
        for key, tag, text in zip(batch["_id"].to_pylist(), batch["_tag"].to_pylist(), texts, strict=True):
            yield key, tag, text.as_py()


def _gathered(rows: Iterator[tuple[int, int, bytes]], most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows in groups of about so many bytes of text; a longer text is a group of its own."""
    group, n = [], 0
    for row in rows:
        group.append(row)
        n += len(row[2])
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


# -- 1: which anchors occur again --------------------------------------------------------------


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and run numbers of sorted keys."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, dtype=bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _again(h: np.ndarray, ids: np.ndarray, tags: np.ndarray, sure: np.ndarray, within: bool) -> np.ndarray:
    """Of rows sorted by hash: those whose hash is elsewhere too (in another document, unless ``within``)."""
    starts, run = _runs(h)
    if len(starts) == 0:
        return np.empty(0, dtype=bool)
    if within:
        several = np.diff(np.r_[starts, len(h)]) > 1
    else:
        other = (ids != ids[starts][run]) | (tags != tags[starts][run])
        several = np.logical_or.reduceat(other, starts)
    return (several | np.logical_or.reduceat(sure, starts))[run]


def _find_anchors(units: Units, buckets: int) -> Callable:
    def send(docs: list) -> pa.RecordBatch | None:
        ids, tags, h, pos, before, after = _joined(docs)
        order = np.argsort(h, kind="stable")
        ids, tags, h, pos, before, after = (x[order] for x in (ids, tags, h, pos, before, after))
        shared = _again(h, ids, tags, np.zeros(len(h), dtype=bool), units.within_document)
        first = np.zeros(len(h), dtype=bool)
        first[_runs(h)[0]] = True
        go = ~shared | first
        rows = list(_send(HASHES, _bucket(h, buckets)[go], ids[go], tags[go], h[go], pos[go], before[go], after[go], shared[go]))
        rows += _send(ANCHORS, _doc_bucket(ids, tags, buckets)[shared], ids[shared], tags[shared], h[shared], pos[shared], before[shared], after[shared])
        return _batch(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for rows in _gathered(_texts(batches), ANCHOR_BYTES):
            ids, tags = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
            own, h, pos, before, after = units.anchors([r[2] for r in rows])
            h = h & HASH_BITS
            waiting.append([ids[own], tags[own], h, pos.astype(np.int32), before.astype(np.uint8), after.astype(np.uint8)])
            n += len(h)
            if n >= MOST_ANCHORS:
                if (batch := send(waiting)) is not None:
                    yield batch
                waiting, n = [], 0
        if n and (batch := send(waiting)) is not None:
            yield batch

    return run


def _match_anchors(units: Units, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches):
            parts = []
            for kind, payload in rows:
                if kind == HASHES:
                    parts.append(_receive(payload))
                else:
                    yield _batch([(bucket, kind, payload)])
            if not parts:
                continue
            columns = _joined(parts)
            order = np.argsort(columns[2], kind="stable")
            ids, tags, h, pos, before, after, sure = (c[order] for c in columns)
            # Rows that were sure were answered where they came from.
            found = _again(h, ids, tags, sure, units.within_document) & ~sure
            out = list(_send(ANCHORS, _doc_bucket(ids, tags, buckets)[found], ids[found], tags[found], h[found], pos[found], before[found], after[found]))
            if out:
                yield _batch(out)

    return run


# -- 2: contexts ---------------------------------------------------------------------------------


def _send_texts(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(_texts(batches), MOST_BYTES):
            ids, tags = (np.array([r[k] for r in group], dtype=np.int64) for k in (0, 1))
            rows = []
            for b, at in _by_bucket(_doc_bucket(ids, tags, buckets)):
                texts = [group[i][2] for i in at]
                rows.append((b, TEXTS, freeze(ids[at], tags[at], np.array([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8))))
            yield _batch(rows)

    return run


def _documents(payload: bytes) -> Iterator[tuple[int, int, bytes]]:
    ids, tags, lengths, raw = thaw(payload)
    joined, at = raw.tobytes(), 0
    for key, tag, n in zip(ids.tolist(), tags.tolist(), lengths.tolist(), strict=True):
        yield key, tag, joined[at : at + n]
        at += n


def _index(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], dict[tuple[int, int], tuple[int, int]]]:
    """Columns sorted by document and position, and each document's rows."""
    if not parts:
        return [], {}
    columns = _joined(parts)
    order = np.lexsort((columns[3], columns[1], columns[0]))
    columns = [c[order] for c in columns]
    ids, tags = columns[0], columns[1]
    starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    ends = np.r_[starts[1:], len(ids)]
    return columns, {(int(ids[a]), int(tags[a])): (int(a), int(b)) for a, b in zip(starts, ends, strict=True)}


def _cut_contexts(units: Units, buckets: int, collapse: bool = True) -> Callable:
    def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of equal contexts of one anchor the first stays; the others repeat all of it."""
        rows.sort(key=lambda r: (r[0], r[1], r[3]))
        first: dict[tuple, tuple] = {}
        keep, spans = [], []
        for row in rows:
            known = first.setdefault((row[2], row[4], row[5], row[6]), row)
            before = (known[0], known[1], known[3]) < (row[0], row[1], row[3]) if units.within_document else known[0] < row[0]
            if not before or not collapse:
                keep.append(row)
            elif row[4] + row[5] >= units.length:
                spans.append((row[0], row[1], row[3] - row[4], row[3] + row[5]))
        out = []
        if keep:
            ids, tags, pos = (np.array([r[k] for r in keep], dtype=np.int64) for k in (0, 1, 3))
            h = np.array([r[2] for r in keep], dtype=np.uint64)
            before, after = (np.array([r[k] for r in keep], dtype=np.uint8) for k in (4, 5))
            fine = _bucket(h, buckets * PARTS)
            for b, own in _by_bucket(fine % buckets):
                parts = [b""] * PARTS
                for part, some in _by_bucket(fine[own] // buckets):
                    at = own[some]
                    lines = [keep[i][6] for i in at]
                    text = np.frombuffer(b"".join(lines), dtype=np.uint8)
                    parts[part] = freeze(ids[at], tags[at], h[at], pos[at].astype(np.int32), before[at], after[at], np.array([len(x) for x in lines], dtype=np.int32), text)
                out.append((b, CONTEXTS, struct.pack(f"<{PARTS}q", *map(len, parts)) + b"".join(parts)))
        out += _span_rows(spans, buckets)
        if out:
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for _, rows in _by_key(batches):
            parts, table = [], None
            for kind, payload in rows:
                if kind == ANCHORS:
                    parts.append(_receive(payload))
                    continue
                if table is None:  # anchors come before texts
                    (columns, table), parts = _index(parts), []
                for key, tag, text in _documents(payload):
                    if (key, tag) not in table:
                        continue
                    a, b = table[key, tag]
                    own = units.cut(text)
                    for h, p, before, after in zip(*(c[a:b].tolist() for c in columns[2:6]), strict=True):
                        waiting.append((key, tag, h, p, before, after, units.context(own, p - before, p + after)))
                    if len(waiting) >= MOST_CONTEXTS:
                        yield from send(waiting)
                        waiting = []
        if waiting:
            yield from send(waiting)

    return run


def _covered(ids: np.ndarray, tags: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal runs of what spans cover, by document; touching ones are one."""
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = (c[order] for c in (ids, tags, start, end))
    new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
    # A document's number in the upper half keeps the furthest end so far from passing on to the next document.
    base = np.cumsum(new) << 32
    furthest = np.maximum.accumulate(base + end)
    new[1:] |= (base + start)[1:] > furthest[:-1]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return ids[new], tags[new], start[new], (furthest - base)[last]


def _span_rows(spans: list[tuple[int, int, int, int]] | np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Blocks of spans (id, tag, start, end)."""
    if len(spans) == 0:
        return []
    ids, tags, start, end = _covered(*np.array(spans, dtype=np.int64).T)
    return list(_send(SPANS, _doc_bucket(ids, tags, buckets), ids, tags, np.zeros(len(ids), dtype=np.int8), start.astype(np.int32), end.astype(np.int32)))


# -- 3: the common-prefix interval tree ---------------------------------------------------------


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per row: how many leading units of a and b are equal, at most ``most``."""
    differs = a != b
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def _intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, depth) of the intervals of n sorted strings that share ``depth`` units, innermost first.

    ``lcp`` has the common prefix of each string with the one before it, from the second on. The
    stack holds the open intervals; one ends where neighbours share less than its depth.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        here = lcp[i - 1] if i < n else 0
        begin = i - 1
        while stack and stack[-1][1] > here:
            begin, depth = stack.pop()
            yield begin, i, depth
        if here and (not stack or stack[-1][1] < here):
            stack.append((begin, here))


def repeat_groups(
    right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, units to the left, units to the right) of each maximal repeat of at least ``length`` units.

    Rows are suffixes (``right``) in sorted order with reversed left contexts: an enhanced suffix
    array with what stands before each suffix. An interval of suffixes that share a prefix is
    split by its left extensions, sorted in their turn: rows that share a left extension of some
    length, and differ or end beyond it, are a group with all its occurrences. A group that lies
    within one child of the interval has a longer prefix in common and is left to that child.
    """
    n = len(right)
    if n < 2:
        return
    lcp = _common(right[1:], right[:-1], np.minimum(n_right[1:], n_right[:-1]))
    for a, b, depth in _intervals(lcp.tolist(), n):
        if depth + int(n_left[a:b].max()) < length:
            continue
        order = a + np.lexsort((n_left[a:b], _bytes_key(left[a:b])))
        shared = _common(left[order[1:]], left[order[:-1]], np.minimum(n_left[order[1:]], n_left[order[:-1]])).tolist()
        # Where a new child of the interval begins: neighbours share no more than its depth.
        child = np.cumsum(np.r_[0, lcp[a : b - 1] <= depth])
        whole = [(0, b - a, 0)] if depth >= length and min(shared) == 0 else []
        for c, d, before in [*_intervals(shared, b - a), *whole]:
            rows = order[c:d]
            if before + depth >= length and child[rows - a].min() != child[rows - a].max():
                yield np.sort(rows), before, depth


def _bytes_key(units: np.ndarray) -> np.ndarray:
    """Rows as byte strings that sort as the units do."""
    big = np.ascontiguousarray(units.astype(units.dtype.newbyteorder(">")))
    return big.view(f"S{units.shape[1] * units.itemsize}").reshape(-1)


def _pad(flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """Rows of so many units from ``first`` on, forwards or backwards, filled up with zeros."""
    out = np.zeros((len(lengths), max(1, int(lengths.max()))), dtype=flat.dtype)
    line = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[line, column] = flat[first[line] + step * column]
    return out


@dataclass
class _Contexts:
    """Contexts of one bucket, sorted by hash, right context, reversed left context and rank."""

    ids: np.ndarray
    tags: np.ndarray
    h: np.ndarray
    pos: np.ndarray
    n_left: np.ndarray
    n_right: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    lines: list[bytes]


def _sorted_contexts(units: Units, columns: list[np.ndarray], lines: list[bytes]) -> _Contexts | None:
    """Contexts whose hash occurs twice. Rank orders places: by id, and within a document by position if that counts."""
    ids, tags, h, pos, before, after = columns
    some = np.sort(_repeated(h))
    if len(some) == 0:
        return None
    ids, tags, h, pos = ids[some], tags[some], h[some], pos[some].astype(np.int64)
    n_left, n_right = before[some].astype(np.int64), after[some].astype(np.int64)
    cut = units.split([lines[i] for i in some.tolist()])
    flat, sizes = np.concatenate(cut), np.array([len(c) for c in cut], dtype=np.int64)
    middle = np.cumsum(sizes) - sizes + n_left
    left, right = _pad(flat, middle - 1, n_left, -1), _pad(flat, middle, n_right, 1)
    order_of = np.lexsort((pos, tags, ids)) if units.within_document else np.lexsort((ids,))
    changes = np.diff(ids[order_of]) != 0
    if units.within_document:
        changes |= (np.diff(tags[order_of]) != 0) | (np.diff(pos[order_of]) != 0)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order_of] = np.cumsum(np.r_[0, changes])
    order = np.lexsort((rank, n_left, _bytes_key(left), n_right, _bytes_key(right), h))
    return _Contexts(*(x[order] for x in (ids, tags, h, pos, n_left, n_right, left, right, rank)), [lines[i] for i in some[order].tolist()])


def _small_groups(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups of 2 to PAIRED rows, some MOST_PAIRS at a time."""
    for size in range(2, PAIRED + 1):
        i, j = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, MOST_PAIRS // len(i))
        for k in range(0, len(own), step):
            some = own[k : k + step, None]
            yield (some + i).reshape(-1), (some + j).reshape(-1)


def _later_spans(c: _Contexts, length: int) -> np.ndarray:
    """Spans (id, tag, start, end) of places that repeat one of lower rank."""
    # Equal contexts: the row of lowest rank stands for them, the others repeat it.
    equal = np.r_[False, (c.h[1:] == c.h[:-1]) & (c.n_left[1:] == c.n_left[:-1]) & (c.n_right[1:] == c.n_right[:-1]) & (c.left[1:] == c.left[:-1]).all(axis=1) & (c.right[1:] == c.right[:-1]).all(axis=1)]
    group = np.cumsum(~equal) - 1
    lowest = c.rank[~equal][group]
    # All spans of a row have its anchor's place in common, so the furthest to either side tell their union.
    full = (c.rank > lowest) & (c.n_left + c.n_right >= length)
    to_left, to_right = np.where(full, c.n_left, 0), np.where(full, c.n_right, 0)
    rest = np.flatnonzero(~equal)
    starts, _ = _runs(c.h[rest])
    sizes = np.diff(np.r_[starts, len(rest)])
    # Of few contexts all pairs are compared at once: two share one maximal repeat around an anchor.
    for x, y in _small_groups(starts, sizes):
        a, b = rest[x], rest[y]
        right = _common(c.right[a], c.right[b], np.minimum(c.n_right[a], c.n_right[b]))
        left = _common(c.left[a], c.left[b], np.minimum(c.n_left[a], c.n_left[b]))
        good = (right + left >= length) & (c.rank[a] != c.rank[b])
        later = np.where(c.rank[a] > c.rank[b], a, b)[good]
        np.maximum.at(to_left, later, left[good])
        np.maximum.at(to_right, later, right[good])
    for k in np.flatnonzero(sizes > PAIRED).tolist():
        own = rest[starts[k] : starts[k] + sizes[k]]
        for rows, left, right in repeat_groups(c.right[own], c.n_right[own], c.left[own], c.n_left[own], length):
            later = own[rows][c.rank[own[rows]] > c.rank[own[rows]].min()]
            to_left[later] = np.maximum(to_left[later], left)
            to_right[later] = np.maximum(to_right[later], right)
    # Rows of lowest rank that equal the one that stands for them lose what it loses.
    same = np.flatnonzero(equal & (c.rank == lowest))
    to_left[same], to_right[same] = to_left[rest[group[same]]], to_right[rest[group[same]]]
    rows = np.flatnonzero(to_left + to_right)
    if len(rows) == 0:
        return np.empty((0, 4), dtype=np.int64)
    return np.stack(_covered(c.ids[rows], c.tags[rows], (c.pos - to_left)[rows], (c.pos + to_right)[rows]), axis=1)


def _contexts_in(rows: Iterator[tuple[int, bytes]], passed: list[tuple[int, bytes]]) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Contexts of a bucket, part by part; rows of other kinds go to ``passed`` before the first part comes."""
    blocks = []
    for kind, payload in rows:
        if kind == CONTEXTS:
            blocks.append(payload)
        else:
            passed.append((kind, payload))
    head = 8 * PARTS
    ends = [head + np.cumsum(struct.unpack_from(f"<{PARTS}q", x)) for x in blocks]
    for part in range(PARTS):
        columns, lines = [], []
        for payload, end in zip(blocks, ends, strict=True):
            own = payload[int(end[part - 1]) if part else head : int(end[part])]
            if not own:
                continue
            *more, sizes, raw = thaw(own)
            columns.append(more)
            text, cuts = raw.tobytes(), np.cumsum(sizes).tolist()
            lines += [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        if columns:
            yield _joined(columns), lines


def _compare(units: Units, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_key(batches):
            passed: list[tuple[int, bytes]] = []
            spans = [np.empty((0, 4), dtype=np.int64)]
            for got in _contexts_in(rows, passed):
                if contexts := _sorted_contexts(units, *got):
                    spans.append(_later_spans(contexts, units.length))
            out = [(bucket, kind, payload) for kind, payload in passed] + _span_rows(np.concatenate(spans), buckets)
            if out:
                yield _batch(out)

    return run


GROUPS = "group string, length int, n_documents int, occurrences array<struct<id: long, start: int>>"
_GROUP_SCHEMA = pa.schema([
    ("group", pa.string()), ("length", pa.int32()), ("n_documents", pa.int32()), ("occurrences", pa.list_(pa.struct([("id", pa.int64()), ("start", pa.int32())]))),
])


def _picks(units: Units, c: _Contexts, row: int, before: int, after: int) -> bool:
    """Whether the repeat picks the anchor by itself, so that all its occurrences have the anchor.

    A repeat may also hold an anchor that is picked by what stands around it in some places; then
    another anchor tells of the repeat.
    """
    own = units.cut(c.lines[row])
    middle = int(c.n_left[row])
    piece = units.context(own, middle - before, middle + after)
    _, h, pos, *_ = units.anchors([piece])
    return bool(((h & HASH_BITS == c.h[row]) & (pos == before)).any())


def _list_groups(units: Units) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            out = []
            for got in _contexts_in(rows, []):
                if (c := _sorted_contexts(units, *got)) is None:
                    continue
                starts, _ = _runs(c.h)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c.h)], strict=True):
                    for k, (at, before, after) in enumerate(repeat_groups(c.right[a:b], c.n_right[a:b], c.left[a:b], c.n_left[a:b], units.length)):
                        places = sorted({(int(c.ids[i]), int(c.tags[i]), int(c.pos[i]) - before) for i in (a + at).tolist()})
                        documents = {p[:2] for p in places}
                        if not _picks(units, c, a + int(at[0]), before, after):
                            continue
                        if len(places) > 1 if units.within_document else len(documents) > 1:
                            found = [{"id": None if i == NO_ID else i, "start": start} for i, _, start in places]
                            out.append((f"{int(c.h[a]):012x}-{k}", before + after, len(documents), found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), _GROUP_SCHEMA.types, strict=True)], schema=_GROUP_SCHEMA)

    return run


def _repeated(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    starts, run = _runs(h[order])
    return order[np.diff(np.r_[starts, len(h)])[run] > 1]


# -- 4: the result --------------------------------------------------------------------------------

RESULT = "_id long, n_units long, n_removed long, n_spans long, kept binary, spans array<struct<start: int, end: int>>"
_RESULT_SCHEMA = pa.schema([
    ("_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def merged(start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what spans cover in 0..n; touching ones are one."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.minimum(np.maximum.accumulate(end[order]), n)
    new = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]
    return start[new], end[last]


def _remove(units: Units, result: Callable[[int, bytes], bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            parts, table = [], None
            for kind, payload in rows:
                if kind == SPANS:
                    parts.append(_receive(payload))
                    continue
                if table is None:
                    (columns, table), parts = _index(parts), []
                out = []
                for key, tag, text in _documents(payload):
                    own = units.cut(text)
                    start, end = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
                    if (key, tag) in table:
                        a, b = table[key, tag]
                        start, end = columns[3][a:b].astype(np.int64), columns[4][a:b].astype(np.int64)
                        if (end == WHOLE).any():
                            start, end = (np.array([0]), np.array([len(own)])) if len(own) >= units.length else (start[:0], end[:0])
                    start, end = merged(start, end, len(own))
                    spans = [{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist(), strict=True)]
                    kept = result(units.keep(own, start.tolist(), end.tolist()))
                    out.append((None if key == NO_ID else key, len(own), int((end - start).sum()), len(spans), kept, spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RESULT_SCHEMA.types, strict=True)], schema=_RESULT_SCHEMA)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), text.alias("_text"))
    return keyed.select("_id", F.xxhash64("_text").alias("_tag"), "_text")


def _mark_copies(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [(i, t, 0, WHOLE) for i, t in zip(batch["_id"].to_pylist(), batch["_tag"].to_pylist(), strict=True)]
            if spans:
                yield _batch(_span_rows(spans, buckets))

    return run


def _distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """All rows, those whose text no smaller id has, the others' ids and tags, and the number of buckets."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, text_col)
    digests = materialize(keyed.select("_id", "_tag", F.unhex(F.md5("_text")).alias("_md5")), "repeat-digests")
    firsts = digests.groupBy("_md5").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copies = with_groups(digests, materialize(firsts, "repeat-firsts"), "_md5", "_n").where("_id > _first").select("_id", "_tag").distinct()
    copies = materialize(copies, "repeat-copies")
    n_copies = copies.count()
    small = F.broadcast(copies) if n_copies <= 2_000_000 else copies
    return keyed, keyed.join(small, ["_id", "_tag"], "left_anti") if n_copies else keyed, copies, buckets


def _exchange(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def _shared_contexts(own: DataFrame, units: Units, buckets: int, collapse: bool) -> DataFrame:
    found = own.mapInArrow(_find_anchors(units, buckets), BLOCK)
    shared = _exchange(found, buckets).mapInArrow(_match_anchors(units, buckets), BLOCK)
    with_texts = shared.unionByName(own.mapInArrow(_send_texts(buckets), BLOCK))
    return _exchange(with_texts, buckets).mapInArrow(_cut_contexts(units, buckets, collapse), BLOCK)


def list_repeats(docs: DataFrame, units: Units, id_col: str, text_col: str) -> DataFrame:
    """Maximal repeats with all their occurrences: group, length, n_documents, occurrences (id, start).

    Of rows with equal texts the smallest id stands for all. Contexts bound a group's length (76
    bytes, or 34 words and some); a longer repeat shows as overlapping groups, one per anchor.
    """
    _, own, _, buckets = _distinct_texts(docs, id_col, text_col)
    contexts = _shared_contexts(own, units, buckets, collapse=False)
    return _exchange(contexts, buckets).mapInArrow(_list_groups(units), GROUPS)


def remove_repeats(docs: DataFrame, units: Units, id_col: str, text_col: str, result: Callable[[bytes], bytes] = lambda kept: kept) -> DataFrame:
    """One row per input row: id, n_units, n_removed, n_spans, kept (or what ``result`` makes of it), spans.

    A row whose text equals that of a smaller id is a copy as a whole and takes no part in the
    comparison. Rows without an id come after all others. Rows are told apart by id and text:
    rows equal in both get equal results.
    """
    keyed, own, copies, buckets = _distinct_texts(docs, id_col, text_col)
    contexts = _shared_contexts(own, units, buckets, collapse=True)
    spans = _exchange(contexts, buckets).mapInArrow(_compare(units, buckets), BLOCK)
    spans = materialize(spans.unionByName(copies.mapInArrow(_mark_copies(buckets), BLOCK)), "repeat-spans")
    texts = keyed.mapInArrow(_send_texts(buckets), BLOCK)
    return _exchange(spans.unionByName(texts), buckets).mapInArrow(_remove(units, result), RESULT).withColumnRenamed("_id", id_col)

