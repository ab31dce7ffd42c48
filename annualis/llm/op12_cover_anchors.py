"""Repeated 35-word windows found by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there is an offset
below the period that puts both on cover positions.  Only stretches that start at cover positions
are hashed (5 of 21 positions); as a stretch is ``PERIOD - 1`` words shorter than a window, two
equal windows hold an equal stretch, the anchor, at the same offset, wherever they start.

An anchor is extended by its context, the 20 words on either side (fewer at the ends of a text):

* anchors with equal contexts repeat every window inside them, so all their words go;
* an anchor whose context is its own, while the stretch occurs elsewhere, has its up to 21
  windows hashed; so has one anchor of each repeated context of that stretch.  Windows that
  occur again there repeat.

Every comparison is a sort by hash in which a row looks at its two neighbours only, so no
group is gathered anywhere.  Rows that repeat inside a task's buffer are settled there and
one of them stands for all in the shuffle, so a passage in a third of all texts costs a few
rows a task.  Two contexts are equal when 95 bits of independent hashes of their words agree, two
windows when 128 bits do.

Words are found and hashed on the bytes of an Arrow batch, many texts at a time: white space
is ASCII, so no UTF-8 sequence holds it, and the hash of any stretch of bytes or words is a difference
of prefix sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import written

WINDOW = 35
#: The differences of the cover take every value modulo the period.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Bytes of texts looked at together (a longer text alone), bytes hashed together, rows of a buffer.
_SLICE, _BLOCK, _BUFFER = 2 << 20, 1 << 20, 1 << 19
#: Contexts of one stretch in a buffer above which all its anchors have their windows hashed.
_MANY = 8

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4D))  # both 5 modulo 8
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

#: Kinds of marks: all windows around anchors first..last repeat; the windows at an anchor are to be hashed.
FREE, REPEATED, OPEN = 0, 1, 2

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASES[0])


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self, base: np.uint64):
        self.bases = base, _U(pow(int(base), -1, 1 << 64))
        self.known = tuple(np.ones(1, np.uint64) for _ in self.bases)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known[0]) < n:
            out = []
            for base in self.bases:
                x = np.full(max(n, 2 * len(self.known[0])), base)
                x[0] = _U(1)
                out.append(np.multiply.accumulate(x))
            self.known = tuple(out)
        return self.known[0][:n], self.known[1][:n]


_POWERS = tuple(map(_Powers, _BASES))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, by prefix sums of numbers times powers."""

    def __init__(self, numbers: np.ndarray, which: int):
        powers, self.back = _POWERS[which](len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(numbers * powers[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


class Slice:
    """Texts first..last-1 of a batch as one byte sequence: ``start`` and ``end`` of every word, and
    ``bounds``, where the words of each text begin (one more at the end)."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, first: int, last: int):
        self.first, self.last, self.data = first, last, data
        word = ~_WHITE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[cuts[cuts < len(data)]] = False
        after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.start, cuts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(int(np.searchsorted(self.end, self.start[i] + _BLOCK, side="right")), i + 1)
            at = self.start[i]
            roll = Rolling(_BYTE[self.data[at:self.end[j - 1]]], 0)
            out[i:j] = roll(self.start[i:j] - at, self.end[i:j] - at)
            i = j
        return out


def slices(texts: pa.Array) -> Iterator[Slice]:
    """A string column (null: empty) cut into slices."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1, i + 1)
        yield Slice(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i, j)
        i = j


class Shape:
    """Lengths that follow from the window and the cover."""

    def __init__(self, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER):
        if len({(a - b) % period for a in cover for b in cover}) < period or window < period:
            raise ValueError("not a difference cover, or a window shorter than its period")
        self.window, self.period, self.reach = window, period, period - 1
        self.stretch = window - self.reach
        self.covered = np.zeros(period, bool)
        self.covered[list(cover)] = True

    def anchors(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, stretch hash, 32 bits of the context's hash) of the anchors of a slice; none
        in texts that are shorter than a window."""
        n = np.diff(s.bounds)
        text = np.repeat(np.arange(len(n)), n)
        begin, length = s.bounds[:-1][text], n[text]
        at = np.arange(len(text)) - begin
        keep = self.covered[at % self.period] & (at + self.stretch <= length) & (length >= self.window)
        text, begin, length, at = text[keep], begin[keep], length[keep], at[keep]
        words = s.hashes()
        left, right = np.maximum(at - self.reach, 0), np.minimum(at + self.window, length)
        a = Rolling(words, 0)(begin + at, begin + at + self.stretch)
        c = _mix(Rolling(words, 1)(begin + left, begin + right) + (at - left).astype(np.uint64))
        return text, at, a.view(np.int64), (c >> _U(33)).astype(np.int64)

    def windows(self, n: int, p: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor at one of ``p`` in a text of n words."""
        i = np.unique((p[:, None] - np.arange(self.period)).ravel())
        return i[(i >= 0) & (i + self.window <= n)]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Whether each row (sorted by the keys) equals the row before it; the first does not."""
    same = np.ones(len(keys[0]), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[1:] == k[:-1]
    return same


def _next(same: np.ndarray) -> np.ndarray:
    return np.append(same[1:], False)


def combine(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sent, repeated, open) rows of a buffer of anchors: those that go into the shuffle, and
    those that are settled without it because the buffer already holds their like."""
    order = np.lexsort((c, a))
    same_a, same_c = _runs(a[order]), _runs(a[order], c[order])
    first_c = ~same_c
    twice = same_c | _next(same_c)
    group = np.cumsum(~same_a) - 1
    many = np.bincount(group, first_c)[group] > _MANY if len(group) else np.zeros(0, bool)
    sent, repeated, opened = (np.zeros(len(a), bool) for _ in range(3))
    sent[order] = np.where(many, ~same_a, first_c)
    repeated[order] = twice
    opened[order] = many & first_c
    return sent, repeated, opened


_DOC = "k1 long, k2 int"


def _spread(k1: np.ndarray) -> np.ndarray:
    """Keys that deal settled rows out evenly."""
    return _mix(k1.view(np.uint64) + np.arange(len(k1), dtype=np.uint64)).view(np.int64)


def _anchor_rows(texts: DataFrame, shape: Shape) -> DataFrame:
    """Anchors of all texts (a, z, kind, k1, k2): a free one has its stretch hash in a, its context
    hash and position in z; marks that are settled at once have their last and first position in z."""

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        k1, k2, p, a, c = (np.concatenate(x) for x in zip(*rows, strict=True))
        sent, repeated, opened = combine(a, c)
        new = np.ones(len(p), bool)  # settled anchors of a text side by side become one mark
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (p[1:] <= p[:-1]) | ~repeated[:-1]
        s, o = np.flatnonzero(sent), np.flatnonzero(opened)
        start = np.flatnonzero(repeated & new)
        end = np.flatnonzero(repeated & np.append(new[1:] | ~repeated[1:], True))
        at = np.concatenate([s, start, o])
        kind = np.repeat(np.array([FREE, REPEATED, OPEN], np.int32), [len(s), len(start), len(o)])
        high = np.concatenate([c[s], p[end], p[o]])
        yield pa.record_batch([pa.array(np.where(kind == FREE, a[at], _spread(k1[at]))), pa.array(high << 32 | p[at]),
                               pa.array(kind), pa.array(k1[at]), pa.array(k2[at])], ["a", "z", "kind", "k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in slices(b.column(2)):
                text, p, a, c = shape.anchors(s)
                rows.append((k1[s.first + text], k2[s.first + text], p, a, c))
                held += len(p)
                if held >= _BUFFER:
                    yield from flush(rows)
                    rows, held = [], 0
        yield from flush(rows)

    return texts.select("k1", "k2", "text").mapInArrow(run, f"a long, z long, kind int, {_DOC}")


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Sorted batches as (table, from, to): rows from..to are new, the row before and the one
    after them (if any) are in the table as well."""
    held, judged = None, 0
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            end = t.num_rows - 1  # the last row waits for the one after it
            if end > judged:
                yield t, judged, end
                held, judged = t.slice(end - 1), 1
            else:
                held = t
    if held is not None:
        yield held, judged, held.num_rows


def _judged_anchors(rows: DataFrame) -> DataFrame:
    """Marks (k1, k2, first, last, kind) of all anchors whose stretch occurs again anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in _with_neighbours(batches):
            a, z, kind, k1, k2 = (t.column(c).to_numpy() for c in range(5))
            free = kind == FREE
            same_a = _runs(a) & free & np.append(False, free[:-1])
            same_c = same_a & _runs(z >> 32)
            repeated = free & (same_c | _next(same_c))
            # the first row of a context after another, the last before another: they stand for it
            opened = free & ((same_a & ~same_c) | (_next(same_a) & ~_next(same_c)))
            here = np.zeros(len(a), bool)
            here[start:end] = True
            k = np.concatenate([np.flatnonzero(x & here) for x in (~free, repeated, opened)])
            if len(k):
                sort = np.repeat(np.array([FREE, REPEATED, OPEN], np.int32), [(x & here).sum() for x in (~free, repeated, opened)])
                first = (z[k] & 0xFFFFFFFF).astype(np.int32)
                last = np.where(sort == FREE, z[k] >> 32, first).astype(np.int32)
                sort = np.where(sort == FREE, kind[k], sort)
                yield pa.record_batch([pa.array(x) for x in (k1[k], k2[k], first, last, sort)], ["k1", "k2", "first", "last", "kind"])

    ordered = rows.repartition("a").sortWithinPartitions("a", "kind", "z")
    return ordered.mapInArrow(run, f"{_DOC}, first int, last int, kind int")


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of every item, items) of a list column; null lists are empty."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _window_rows(marked: DataFrame, shape: Shape) -> DataFrame:
    """Windows at the open anchors (w1, w2, kind, k1, k2, at); those that occur twice in a buffer are
    settled there, and one of them goes on as a free one to meet others."""

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        k1, k2, at, w1, w2 = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((w2, w1))
        same = _runs(w1[order], w2[order])
        twice, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
        twice[order], later[order] = same | _next(same), same
        k = np.concatenate([np.flatnonzero(~later), np.flatnonzero(twice)])
        kind = np.repeat(np.array([FREE, REPEATED], np.int32), [(~later).sum(), twice.sum()])
        yield pa.record_batch([pa.array(np.where(kind == FREE, w1[k], _spread(k1[k]))),
                               *(pa.array(x) for x in (w2[k], kind, k1[k], k2[k], at[k].astype(np.int32)))],
                              ["w1", "w2", "kind", "k1", "k2", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            k1, k2 = b.column(1).to_numpy(), b.column(2).to_numpy()
            row, marks = _listed(b.column(4))
            first, kind = (marks.field(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            row, first = row[kind == OPEN], first[kind == OPEN]
            for s in slices(b.column(3)):
                n = np.diff(s.bounds)
                lo, hi = np.searchsorted(row, [s.first, s.last])
                text, at = [], []
                for part in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(row[lo:hi])) + 1):
                    if len(part):
                        i = shape.windows(int(n[row[part[0]] - s.first]), first[part].astype(np.int64))
                        text.append(np.full(len(i), row[part[0]] - s.first))
                        at.append(i)
                if not text:
                    continue
                text, at = np.concatenate(text), np.concatenate(at)
                begin, words = s.bounds[:-1][text] + at, s.hashes()
                w1, w2 = (Rolling(words, j)(begin, begin + shape.window).view(np.int64) for j in (0, 1))
                rows.append((k1[s.first + text], k2[s.first + text], at, w1, w2))
                held += len(at)
                if held >= _BUFFER:
                    yield from flush(rows)
                    rows, held = [], 0
        yield from flush(rows)

    # with the id, so that the exchange of the texts is the one that the results are made from
    return marked.select("id", "k1", "k2", "text", "marks").mapInArrow(run, f"w1 long, w2 long, kind int, {_DOC}, at int")


def _judged_windows(rows: DataFrame) -> DataFrame:
    """k1, k2, at of the windows that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, end in _with_neighbours(batches):
            w1, w2, kind = (t.column(c).to_numpy() for c in range(3))
            free = kind == FREE
            same = _runs(w1, w2) & free & np.append(False, free[:-1])
            k = np.flatnonzero((same | _next(same) | ~free)[start:end]) + start
            if len(k):
                yield t.select(["k1", "k2", "at"]).take(k).combine_chunks().to_batches()[0]

    ordered = rows.repartition("w1").sortWithinPartitions("w1", "kind", "w2")
    return ordered.mapInArrow(run, f"{_DOC}, at int")


def kept_words(s: Slice, gone: np.ndarray) -> list[bytes]:
    """The words of each text that are not gone, joined by one space."""
    out, keep = s.data.copy(), np.zeros(len(s.data) + 1, np.int8)
    stay = np.flatnonzero(~gone)
    text = np.searchsorted(s.bounds, stay, side="right") - 1
    followed = np.append(text[1:] == text[:-1], False)[:len(text)]  # by another kept word of the text: there is a byte between
    keep[s.start[stay]] += 1
    keep[s.end[stay] + followed] -= 1
    out[s.end[stay][followed]] = 0x20
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    size = np.bincount(text, s.end[stay] - s.start[stay] + followed, len(s.bounds) - 1).astype(np.int64) if len(stay) else \
        np.zeros(len(s.bounds) - 1, np.int64)
    ends = np.cumsum(size)
    data = out[inside].tobytes()
    return [data[e - n:e] for n, e in zip(size.tolist(), ends.tolist(), strict=True)]


def _finished(marked: DataFrame, shape: Shape, id_type: str, keep_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, marks = _listed(b.column(2))
            first, last, kind = (marks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            done = kind == REPEATED
            again, at = _listed(b.column(3))
            at = at.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.concatenate([row[done], again])
            start = np.concatenate([np.maximum(first[done] - shape.reach, 0), at])
            end = np.concatenate([last[done], at]) + shape.window
            order = np.argsort(row, kind="stable")
            row, start, end = row[order], start[order], end[order]
            for s in slices(b.column(1)):
                n = np.diff(s.bounds)
                lo, hi = np.searchsorted(row, [s.first, s.last])
                text = row[lo:hi] - s.first
                change = np.zeros(len(s.start) + 1, np.int64)
                np.add.at(change, s.bounds[:-1][text] + np.minimum(start[lo:hi], n[text]), 1)
                np.add.at(change, s.bounds[:-1][text] + np.minimum(end[lo:hi], n[text]), -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.append(0, np.cumsum(gone))
                kept = kept_words(s, gone)
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                said = pa.array([x.decode() for x in kept] if keep_text else [None] * len(kept), pa.string())
                yield pa.record_batch([b.column(0).slice(s.first, s.last - s.first), pa.array(n), pa.array(np.diff(total[s.bounds])), sha, said],
                                      ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return marked.select("id", "text", "marks", "again").mapInArrow(
        run, f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   period: int = PERIOD, cover: tuple[int, ...] = COVER, keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept_text]): one row per row of ``docs``.

    Words are maximal runs of characters other than ASCII white space, unchanged.  A word goes if
    any ``window`` consecutive words that hold it also start elsewhere, in the same row or any
    other; all windows are judged on the input.  kept_sha256 is of the kept words joined by one
    space, in UTF-8; ``keep_text`` returns them as well.  Null and word-free texts have no words;
    texts of fewer words than a window lose none; repeated rows are rows of their own, so both
    lose their windows; null ids are kept; an empty table gives an empty result; extra columns are
    ignored.  A row is known by 80 bits of hashes of its id and text; a text has less than 2^31 bytes."""
    shape = Shape(window, period, cover)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumns({"k1": F.xxhash64("text", "id"), "k2": F.hash("id", "text").bitwiseAND(0xFFFF)})
    marks = _judged_anchors(_anchor_rows(texts, shape))
    marks = written(marks.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last", "kind")).alias("marks")), "marks")
    # both joins read the same exchange of the texts
    searched = texts.join(marks.where(F.exists("marks", lambda m: m["kind"] == OPEN)), ["k1", "k2"])
    again = _judged_windows(_window_rows(searched, shape)).groupBy("k1", "k2").agg(F.collect_set("at").alias("again"))
    known = marks.join(again, ["k1", "k2"], "left")
    out = _finished(texts.join(known, ["k1", "k2"], "left"), shape, id_type, keep_text)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else []))
