"""Suffix-array dedup: repeated byte strings are removed but for their first place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableforge.llm.texts import stored

LENGTH = 100
# Bytes of an anchor string; every window of LENGTH bytes has one.
ANCHOR = 24
FLUSH = 1 << 20
SORT_BYTES = 1 << 21
# Contexts of one anchor that are sorted together; with more, windows are dealt out singly.
CROWD = 4096
# An anchor with more than this share of a sample's contexts is dealt out singly from the start.
HOT_SHARE = 1e-4
SAMPLE = 16

_BASE = 0x9E3779B97F4A7C15
_byte_hash = xxhash.xxh3_64_intdigest
_MARK, _SORT, _SINGLE = 0, 1, 2
_OUT = "kind int, key long, key2 long, key3 long, doc long, start long, n long"


# ---- two-stage suffix sorting -------------------------------------------------------------


def _word_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; the text is followed by zeros."""
    padded = np.zeros(len(text) + LENGTH + 16, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(len(text) + LENGTH + 8, np.uint64)
    for i in range(8):
        out |= padded[i : i + len(out)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def _masked(words: np.ndarray, at: np.ndarray, depth: int, length: int) -> np.ndarray:
    found = words[at + depth]
    rest = length - depth
    return found if rest >= 8 else found & np.uint64((2**64 - 1) ^ (2 ** (64 - 8 * rest) - 1))


def _sort_directly(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Places sorted by their first ``length`` bytes, eight at a time; ties stay together."""
    key = _masked(words, at, 0, length)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    first = np.ones(len(at), bool)
    first[1:] = key[1:] != key[:-1]
    for depth in range(8, length, 8):
        group = np.cumsum(first) - 1
        tied = ~first
        tied[:-1] |= ~first[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        key, g = _masked(words, at[some], depth, length), group[some]
        # Most tied groups are copies: only those that differ here are sorted.
        differ = np.zeros(len(some), bool)
        differ[1:] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        if not differ.any():
            continue
        unequal = np.zeros(group[-1] + 1, bool)
        unequal[g[differ]] = True
        part = np.flatnonzero(unequal[g])
        order = np.lexsort((key[part], g[part]))
        at[some[part]] = at[some[part]][order]
        key[part] = key[part][order]
        new = np.zeros(len(some), bool)
        new[1:] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        first[some[new]] = True
    return at


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The wanted places of ``text`` in order of the ``length`` bytes that follow.

    Two-stage sorting. A suffix smaller than its successor (type B) is sorted directly. A larger one
    (type A) starts with a byte that is at least its successor's first, so one scan of the buckets in
    order of their first byte finds it a place: the predecessors of a bucket's suffixes, in
    order, are the next type A suffixes of their own buckets. Where a wanted place is of
    type A, the places after it up to the next type B are sorted with it.
    """
    n = len(text)
    if not wanted.any():
        return np.empty(0, np.int64)
    # The end of the text counts as a byte smaller than all others.
    codes = np.zeros(n + 1, np.int16)
    codes[:n] = text
    codes[:n] += 1
    step = np.sign(np.diff(codes)).astype(np.int8)
    nonzero = np.where(step != 0, np.arange(n), n - 1)
    follow = np.minimum.accumulate(nonzero[::-1])[::-1]
    type_b = np.ones(n + 1, bool)
    type_b[:n] = step[follow] > 0
    next_b = np.where(type_b, np.arange(n + 1), n)
    next_b = np.minimum.accumulate(next_b[::-1])[::-1]
    # Wanted places, and from the last of a run of them on to the next type B.
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, ends, 1)
    np.add.at(change, next_b[ends] + 1, -1)
    live = (np.cumsum(change)[: n + 1] > 0)
    live[:n] |= wanted
    direct = _sort_directly(_word_at(text), np.flatnonzero(live & type_b), length)
    first = codes[direct]
    direct = direct[np.argsort(first, kind="stable")]
    bounds = np.searchsorted(codes[direct], np.arange(258))
    led: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def before(bucket: np.ndarray) -> np.ndarray:
        """The type A predecessors of a bucket's places, in order."""
        previous = bucket[bucket > 0] - 1
        return previous[live[previous] & ~type_b[previous]]

    for c in range(257):
        queue = np.concatenate(led[c]) if led[c] else np.empty(0, np.int64)
        whole = []
        while len(queue):
            whole.append(queue)
            previous = before(queue)
            same = codes[previous] == c
            queue = previous[same]
        whole.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(whole)
        led[c] = []
        if len(bucket):
            out.append(bucket)
            previous = before(bucket)
            heads = codes[previous]
            previous, heads = previous[heads > c], heads[heads > c]
            order = np.argsort(heads, kind="stable")
            previous, heads = previous[order], heads[order]
            cuts = np.flatnonzero(np.diff(heads)) + 1
            for part in np.split(previous, cuts) if len(previous) else []:
                led[codes[part[0]]].append(part)
    order = np.concatenate(out)
    order = order[order < n]
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place but the first, the bytes it shares with the one before it, up to ``length``."""
    words = _word_at(text)
    shared = np.zeros(max(len(order) - 1, 0), np.int64)
    open_ = np.arange(len(shared))
    for depth in range(0, length, 8):
        apart = words[order[open_] + depth] ^ words[order[open_ + 1] + depth]
        equal = np.zeros(len(open_), np.int64)
        for bits in range(56, -1, -8):
            equal += apart < np.uint64(1 << bits) if bits else apart == 0
        shared[open_] += equal
        open_ = open_[equal == 8]
    return np.minimum(shared, length)


# ---- anchors ------------------------------------------------------------------------------


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                factors = np.full(size, np.uint64(base))
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _prefix_sums(text: np.ndarray) -> np.ndarray:
    n = len(text)
    _Powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _Powers.up[:n], out=sums[1:])
    return sums


def _string_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    return (sums[end] - sums[start]) * _Powers.down[start] + (end - start).astype(np.uint64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    runs = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(values)] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:runs], ahead[width - 1 : width - 1 + runs])


def _contexts(docs: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """The windows of some texts, grouped by the anchor each contains.

    A window's anchor is the string of ANCHOR bytes with the least hash in it, the leftmost on a tie, so
    equal windows have equal anchors at equal offsets. ``docs`` has (id, place of the first
    byte, bytes). Returns for every run of windows with one anchor: the anchor's hash, two unlike hashes of
    all the run covers, the id, the place of the first window, and the number of windows.
    """
    text = np.frombuffer(b"".join(d[2] for d in docs), np.uint8)
    sizes = np.array([len(d[2]) for d in docs])
    if len(text) < length:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    sums = _prefix_sums(text)
    places = np.arange(len(text) - ANCHOR + 1)
    anchors = _stirred(_string_hash(sums, places, places + ANCHOR))
    low = np.uint64((1 << 24) - 1)
    best = _sliding_min((anchors & ~low) | places.astype(np.uint64), length - ANCHOR + 1) & low
    inside = np.zeros(len(best) + 1, np.int32)
    has = sizes >= length
    np.add.at(inside, offsets[:-1][has], 1)
    np.add.at(inside, offsets[1:][has] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    anchor = best[windows].astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(windows)))
    start = windows[head]
    at = np.searchsorted(offsets, start, side="right") - 1
    content = _string_hash(sums, start, start + count + length - 1)
    content = _stirred(content ^ ((anchor[head] - start).astype(np.uint64) << np.uint64(40)))
    # A polynomial modulo 2**64 alone can be made to collide.
    raw = text.tobytes()
    ends = (start + count + length - 1).tolist()
    other = np.fromiter((_byte_hash(raw[a:b]) for a, b in zip(start.tolist(), ends, strict=True)), np.uint64, len(start))
    ids, bases = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
    return (
        anchors[anchor[head]].view(np.int64),
        content.view(np.int64),
        other.view(np.int64),
        ids[at],
        start - offsets[at] + bases[at],
        count,
    )


def _firsts(key, key2, key3, doc, start):
    """An order by the keys, doc, start, which rows head their keys and which equal that head."""
    order = np.lexsort((start, doc, key3, key2, key))
    key, key2, key3, doc, start = (c[order] for c in (key, key2, key3, doc, start))
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]) | (key3[1:] != key3[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order, head, (doc == doc[lead]) & (start == start[lead])


def _batch(kind, key, key2, key3, doc, start, n) -> pa.RecordBatch:
    size = len(doc)
    columns = [np.broadcast_to(np.asarray(c), size) for c in (kind, key, key2, key3, doc, start, n)]
    kinds = [pa.int32(), *[pa.int64()] * 6]
    names = ["kind", "key", "key2", "key3", "doc", "start", "n"]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, kinds, strict=True)], names
    )


def _once(kind: int, key, key2, key3, doc, start, n) -> Iterator[pa.RecordBatch]:
    """Of equal keys, the first row as ``kind`` and the others as marks.

    So a string that is everywhere leaves a task as one row per flush, and its other places in the
    flush are settled.
    """
    if len(doc):
        order, head, same = _firsts(key, key2, key3, doc, start)
        yield _batch(kind, *(c[order[head]] for c in (key, key2, key3, doc, start, n)))
        later = order[~same]
        yield _batch(_MARK, 0, 0, 0, doc[later], start[later], n[later])


def _context_rows(docs: list[tuple[int, int, bytes]], length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Contexts, each once; the windows of hot anchors singly."""
    key, key2, key3, doc, start, n = _contexts(docs, length)
    single = np.isin(key, hot)
    yield from _once(_SORT, *(c[~single] for c in (key, key2, key3, doc, start, n)))
    if single.any():
        texts = {(d, base): data for d, base, data in docs}
        pieces = []
        for d, s, count in zip(doc[single].tolist(), start[single].tolist(), n[single].tolist(), strict=True):
            base = (s // FLUSH) * FLUSH
            pieces.append((d, s, texts[d, base][s - base : s - base + count + length - 1]))
        for at in range(0, len(pieces), 1 << 14):
            yield from _windows(pieces[at : at + (1 << 14)], length)


def _anchor_rows(length: int, hot: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (value.as_py() or "").encode()
                # A long text goes in pieces that overlap by one byte less than a window.
                for base in range(0, max(len(data) - length + 1, 0), FLUSH):
                    held.append((doc, base, data[base : base + FLUSH + length - 1]))
                    size += len(held[-1][2])
                    if size >= FLUSH:
                        yield from _context_rows(held, length, hot)
                        held, size = [], 0
        if held:
            yield from _context_rows(held, length, hot)

    return rows


def _hot_anchors(known: DataFrame, length: int) -> np.ndarray:
    """Anchors that hold more than HOT_SHARE of the contexts of a sixteenth of the documents.

    They number at most 1 / HOT_SHARE. They only decide how work is dealt out, not its result.
    """
    sample = known.filter(F.pmod(F.xxhash64("id", "text"), F.lit(SAMPLE)) == 0)
    counts = stored(
        sample.mapInArrow(_anchor_rows(length, np.empty(0, np.int64)), _OUT)
        .filter(F.col("kind") == _SORT)
        .groupBy("key")
        .agg(F.count("*").alias("n")),
        "repeat-sample",
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > max(64, total * HOT_SHARE)).select("key").collect()
    return np.array(sorted(r["key"] for r in found), np.int64)


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, pa.ChunkedArray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return {n: table.column(n) for n in names}


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks for all but the first place of a context; anchors with several contexts go on."""
    names = ["kind", "key", "key2", "key3", "doc", "start", "n"]
    found = _columns(batches, names)
    if found is None:
        return
    kind, key, key2, key3, doc, start, n = (found[c].to_numpy() for c in names)
    mark, single = kind == _MARK, kind == _SINGLE
    yield _batch(_MARK, 0, 0, 0, doc[mark], start[mark], n[mark])
    if single.any():
        some = np.flatnonzero(single)
        order, _, same = _firsts(*(c[some] for c in (key, key2, key3, doc, start)))
        later = some[order[~same]]
        yield _batch(_MARK, 0, 0, 0, doc[later], start[later], n[later])
    key, key2, key3, doc, start, n = (c[kind == _SORT] for c in (key, key2, key3, doc, start, n))
    if not len(key):
        return
    order, head, same = _firsts(key, key2, key3, doc, start)
    later = order[~same]
    yield _batch(_MARK, 0, 0, 0, doc[later], start[later], n[later])
    lead = order[head]
    anchor, at = np.unique(key[lead], return_inverse=True)
    crowd = np.bincount(at, minlength=len(anchor))[at]
    for kind, some in ((_SORT, (crowd > 1) & (crowd <= CROWD)), (_SINGLE, crowd > CROWD)):
        of = lead[some]
        yield _batch(kind, key[of], key2[of], key3[of], doc[of], start[of], n[of])


def _fetch(length: int):
    """The bytes of the contexts to sort; for crowded anchors a row per window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = []
            keys, docs, starts, counts, bytes_ = [], [], [], [], []
            for doc, value, wanted in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc, data = doc.as_py(), value.as_py().encode()
                for w in wanted.as_py():
                    piece = data[w["start"] : w["start"] + w["n"] + length - 1]
                    if w["kind"] == _SINGLE:
                        single.append((doc, w["start"], piece))
                        continue
                    keys.append(w["key"])
                    docs.append(doc)
                    starts.append(w["start"])
                    counts.append(w["n"])
                    bytes_.append(piece)
            parts = [_batch(_SORT, np.array(keys, np.int64), 0, 0, np.array(docs, np.int64), np.array(starts, np.int64), np.array(counts, np.int64))]
            data = [pa.array(bytes_, pa.binary())]
            for start in range(0, len(single), 1 << 15):
                for part in _windows(single[start : start + (1 << 15)], length):
                    parts.append(part)
                    data.append(pa.nulls(part.num_rows, pa.binary()))
            for part, column in zip(parts, data, strict=True):
                yield part.append_column("data", column)

    return rows


def _windows(pieces: list[tuple[int, int, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    text = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    runs = sizes - length + 1
    at = np.repeat(np.arange(len(pieces)), runs)
    place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    start = offsets[at] + place
    h = _string_hash(_prefix_sums(text), start, start + length)
    # The halves of the window make the second key.
    half = _string_hash(_prefix_sums(text[::-1].copy()), len(text) - start - length, len(text) - start)
    doc, first = np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces])
    yield from _once(
        _SINGLE, _stirred(h).view(np.int64), _stirred(half).view(np.int64), np.zeros(len(at), np.int64),
        doc[at], first[at] + place, np.ones(len(at), np.int64),
    )


def _sort_contexts(data: list[bytes], doc, start, n, length: int) -> Iterator[pa.RecordBatch]:
    """Marks for the windows of these contexts that have an earlier equal one among them."""
    text = np.frombuffer(b"".join(data), np.uint8)
    sizes = np.array([len(d) for d in data])
    offsets = np.cumsum(sizes) - sizes
    wanted = np.zeros(len(text) + 1, np.int32)
    np.add.at(wanted, offsets, 1)
    np.add.at(wanted, offsets + n, -1)
    order = two_stage_sort(text, np.cumsum(wanted)[:-1] > 0, length)
    if len(order) < 2:
        return
    equal = common_prefixes(text, order, length) >= length
    group = np.cumsum(np.append(True, ~equal)) - 1
    several = np.zeros(len(order), bool)
    several[1:] = equal
    several[:-1] |= equal
    order, group = order[several], group[several]
    at = np.searchsorted(offsets, order, side="right") - 1
    docs, starts = doc[at], start[at] + order - offsets[at]
    by, _, same = _firsts(group, np.zeros_like(group), np.zeros_like(group), docs, starts)
    docs, starts = docs[by[~same]], starts[by[~same]]
    # Neighbouring windows of a document make one mark.
    by = np.lexsort((starts, docs))
    docs, starts = docs[by], starts[by]
    if len(docs):
        new = np.append(True, (docs[1:] != docs[:-1]) | (np.diff(starts) > 1))
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(docs)) - 1
        yield _batch(_MARK, 0, 0, 0, docs[head], starts[head], starts[last] - starts[head] + 1)


def _sorted_marks(length: int):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "key", "key2", "key3", "doc", "start", "n"]
        found = _columns(batches, [*names, "data"])
        if found is None:
            return
        kind, key, key2, key3, doc, start, n = (found[c].to_numpy() for c in names)
        mark, single = kind == _MARK, np.flatnonzero(kind == _SINGLE)
        yield _batch(_MARK, 0, 0, 0, doc[mark], start[mark], n[mark])
        if len(single):
            order, _, same = _firsts(*(c[single] for c in (key, key2, key3, doc, start)))
            later = single[order[~same]]
            yield _batch(_MARK, 0, 0, 0, doc[later], start[later], n[later])
        # Equal windows have equal anchors, so some anchors at a time are sorted.
        some = np.flatnonzero(kind == _SORT)
        some = some[np.argsort(key[some], kind="stable")]
        size = np.cumsum(n[some] + length - 1)
        change = np.append(True, np.diff(key[some]) != 0)
        begin = np.flatnonzero(change)
        chunk = (size[begin] - n[some][begin] - length + 1) // SORT_BYTES if len(some) else begin
        cuts = begin[np.flatnonzero(np.diff(chunk)) + 1] if len(begin) else []
        for part in np.split(some, cuts):
            if len(part):
                data = found["data"].take(pa.array(part)).to_pylist()
                yield from _sort_contexts(data, doc[part], start[part], n[part], length)

    return marks


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (value or "").encode()
                spans: list[list[int]] = []
                for start, end in sorted((m["start"], m["start"] + m["n"] + length - 1) for m in marks or []):
                    end = min(end, len(data))
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    elif start < end:
                        spans.append([start, end])
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc, len(data), len(data) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            span = pa.list_(pa.list_(pa.int64()))
            types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return cut


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts earlier.

    Earlier means a smaller id, or a smaller place in the same document; strings are judged on
    the whole input as UTF-8 and never cross documents.

    A suffix array of all texts would be many times their size and in one place, so the windows
    are first dealt out: each belongs to the anchor string with the least hash in it, and equal windows
    have equal anchors. Windows next to each other with one anchor form a context. Equal
    contexts leave a task once; all but the first place of a context is settled by two unlike hashes of
    64 bits besides the anchor's. The
    different contexts of an anchor are sorted by two-stage suffix sorting in the anchor's
    task, a few megabytes at a time, and adjacent common prefixes of ``length`` bytes give the equal
    windows. An anchor with very many different contexts, such as a short line of many documents, has its
    windows dealt out singly by their hash, so no group has to fit one task: those that hold more
    than a ten-thousandth of a sample from the start, others with over 4096 contexts later.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, [start, end) in
    bytes), ``kept`` (binary, what is left) and ``kept_sha256``. Other columns are ignored. A null or empty
    text has no bytes. A row without id takes no part and is kept whole. Rows with the same id
    count as one document: equal places in them are not earlier than each other, and what is
    removed at a place of one is removed there from all.
    """
    if not ANCHOR < length:
        raise ValueError("strings must be longer than their anchors")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    known = rows.filter("id IS NOT NULL AND text IS NOT NULL")
    contexts = known.mapInArrow(_anchor_rows(length, _hot_anchors(known, length)), _OUT)
    # Marks stay spread as they are; contexts meet by anchor.
    spread = F.when(F.col("kind") == _MARK, F.xxhash64("doc", "start")).otherwise(F.col("key"))
    first = stored(contexts.repartition(spread).mapInArrow(_settle, _OUT), "repeat-contexts")
    wanted = (
        first.filter(F.col("kind") != _MARK)
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("wanted"))
    )
    fetched = (
        known.join(wanted, F.col("id") == F.col("of"))
        .select("id", "text", "wanted")
        .mapInArrow(_fetch(length), f"{_OUT}, data binary")
    )
    second = stored(fetched.repartition(spread).mapInArrow(_sorted_marks(length), _OUT), "repeat-windows")
    marks = (
        first.filter(F.col("kind") == _MARK).union(second)
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    )
    return (
        rows.join(marks, F.col("id") == F.col("of"), "left")
        .select("id", "text", "marks")
        .mapInArrow(
            _cut(length),
            "id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string",
        )
        .withColumnRenamed("id", doc_id)
    )


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
