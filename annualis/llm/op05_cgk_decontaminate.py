"""Benchmark decontamination: which documents hold a passage within a small edit distance of
a benchmark item.

Texts are compared as lower-cased words with single spaces.  The CGK embedding walks over a
window with a pointer: step j outputs the character under the pointer and then moves it by a
random bit that depends on (j, character).  Equal stretches give equal outputs, and after an
edit two walks meet again, so edit distance becomes Hamming distance.  Bit sampling keeps
``SAMPLES`` of the outputs as the hash of a window; ``REPEATS`` independent walks and samples
raise recall.  Windows start at every word of a document and at every word of an item, in
scripts without word spaces at every character, so
one undamaged or re-synchronised stretch anywhere in the passage is enough; short items have
shorter and more walks, so that no walk leaves its item and every item has several starts.

Every hash hit is aligned to the whole item and verified exactly: the smallest edit distance
(Myers' bit-parallel algorithm) between the item and any stretch of the item-sized window
around the hit must be at most ``1 - SIMILARITY`` of the item's length.

Items are the small side: they are indexed in blocks of at most ``BLOCK_CHARS`` characters,
and every block is one pass over the documents, whatever the number of items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import filter_batches, slices_by_size

SIMILARITY = 0.8
STEPS, SAMPLES, REPEATS = 64, 16, 2
#: Steps for items below twice ``STEPS`` characters: the walks of these are twice as many.
SHORT_STEPS = (48, 32, 16, 8, 4, 2, 1)
BLOCK_CHARS = 4_000_000
#: Scripts without word spaces: Thai and Lao, Tibetan and Burmese, Khmer, kana, Chinese characters.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Hits are first looked up after so many sampled characters, then after all.
_STAGES = (5, 9)
_BITS = 20
_GAP = re.compile(r"[\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def smallest_distance(item: str, window: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``window`` nearest to the whole ``item``, if within
    ``most`` edits (first such end)."""
    at = window.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (most + 1, -1)
    for j, c in enumerate(window):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere in the window
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _codes(c: np.ndarray) -> np.ndarray:
    """Character classes of a text's code points (Latin letters keep classes of their own)."""
    return (c ^ (c >> np.uint32(8))).astype(np.uint8)


def _steps(length: int) -> int:
    """Steps of an item's walks: few enough to leave many starts in it."""
    if length >= 2 * STEPS:
        return STEPS
    return next((s for s in SHORT_STEPS if 4 * s <= 3 * length), 1)


def _word_starts(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(codes == 32) + 1
    at = np.concatenate([np.zeros(1, at.dtype), at])
    wide = np.flatnonzero(points >= UNSPACED[0][0])
    wide = wide[np.any([(points[wide] >= lo) & (points[wide] <= hi) for lo, hi in UNSPACED], axis=0)]
    return np.union1d(at, np.concatenate([wide, wide + 1])) if len(wide) else at


class _Walk:
    """One walk with its sampled steps."""

    def __init__(self, steps: int, seed: int):
        rng = np.random.default_rng([seed, steps])
        self.moves = rng.integers(0, 2, (steps, 256), dtype=np.uint8)
        self.sampled = np.sort(rng.choice(steps, min(SAMPLES, steps), replace=False))
        self.stages: list[np.ndarray] = []
        self.hashes = np.zeros(0, np.uint64)
        self.first = self.entries = np.zeros(0, np.int64)

    def hash(self, codes: np.ndarray, starts: np.ndarray, note=None):
        """(surviving starts, hash of each): ``note(k, hashes)`` after each stage may give a
        mask of the starts to go on with.  ``codes`` is padded beyond the last walk."""
        pos = starts.astype(np.int32)
        h = np.zeros(len(pos), np.uint64)
        j = 0
        for k, step in enumerate(self.sampled):
            while j <= step:
                c = codes[pos]
                if j < step:
                    pos = pos + self.moves[j][c]
                j += 1
            h = (h + c + np.uint64(1)) * _MULT
            pos = pos + self.moves[step][c]
            if note and k + 1 in _STAGES:
                live = note(_STAGES.index(k + 1), h)
                pos, h, starts = pos[live], h[live], starts[live]
                if not len(pos):
                    break
        return starts, h

    def learn(self, codes: np.ndarray, starts: np.ndarray) -> None:
        self.stages = []

        def note(k, h):
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            self.stages.append(seen)
            return slice(None)

        _, h = self.hash(codes, starts, note)
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first, self.entries = np.append(first, len(h)), order

    def hits(self, codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start in the text, entry number) of every start whose hash is an entry's."""
        starts, h = self.hash(codes, starts, lambda k, h: self.stages[k][h >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        for i in np.flatnonzero(self.hashes[at] == h):
            for e in self.entries[self.first[at[i]]:self.first[at[i] + 1]]:
                yield int(starts[i]), int(e)


class ItemIndex:
    """Hashes of all word starts of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, repeats: int = REPEATS):
        items = sorted({(i, t) for i, raw in items if (t := normalise(raw))})
        self.items = [(i, t, int((1 - similarity) * len(t) + 1e-9)) for i, t in items]
        self.classes: list[tuple[list[_Walk], np.ndarray, np.ndarray]] = []
        by_steps: dict[int, list[int]] = {}
        for n, (_, t, _) in enumerate(self.items):
            by_steps.setdefault(_steps(len(t)), []).append(n)
        for steps, members in sorted(by_steps.items()):
            texts = [self.items[n][1] for n in members]
            codes, number, offset, base, at = [], [], [], [], 0
            for n, t in zip(members, texts, strict=True):
                points = _points(t)
                c = _codes(points)
                s = _word_starts(points, c)
                s = s[s <= len(t) - steps]
                codes.append(c)
                number.append(np.full(len(s), n))
                offset.append(s)
                base.append(s + at)
                at += len(c)
            joined = np.concatenate([*codes, np.zeros(steps + 1, np.uint8)])
            walks = [_Walk(steps, seed) for seed in range(repeats if steps == STEPS else 2 * repeats)]
            for w in walks:
                w.learn(joined, np.concatenate(base))
            self.classes.append((walks, np.concatenate(number), np.concatenate(offset)))

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text number, item id, edit distance, start) of every item found in a text, the
        nearest and then first stretch of each; start counts characters of the normalised text."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for s, e in slices_by_size(texts):
            norm = [normalise(t) for t in texts[s:e]]
            first = np.cumsum([0, *(len(t) + 1 for t in norm)])
            points = _points(" ".join(norm))
            plain = _codes(points)
            codes = np.concatenate([plain, np.zeros(STEPS + 2, np.uint8)])
            starts = _word_starts(points, plain)
            starts = starts[starts < first[-1] - 1]
            for walks, number, offset in self.classes:
                near: set[tuple[int, int, int]] = set()
                for w in walks:
                    for at, entry in w.hits(codes, starts):
                        doc = int(np.searchsorted(first, at, "right")) - 1
                        near.add((doc, int(number[entry]), at - int(first[doc]) - int(offset[entry])))
                last: tuple[int, int, int] | None = None
                for doc, n, at in sorted(near):
                    item_id, item, most = self.items[n]
                    if last and last[:2] == (doc, n) and at - last[2] <= most // 2:
                        continue  # the window verified last holds this one's item too
                    last = (doc, n, at)
                    lo = max(0, at - most)
                    hit = smallest_distance(item, norm[doc][lo:max(0, at) + len(item) + 2 * most + 1], most)
                    if hit:
                        got = (hit[0], max(0, lo + hit[1] - len(item)))
                        key = (s + doc, item_id)
                        found[key] = min(found.get(key, got), got)
        return [(i, item, d, at) for (i, item), (d, at) in sorted(found.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The distinct items, collected in blocks of about ``block_chars`` characters."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")) \
        .where("id is not null and t is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).distinct().collect()
        if part:
            yield [(r["id"], r["t"]) for r in part]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
               repeats: int = REPEATS) -> DataFrame:
    """(id_col, item_id, distance, start): one row per document id and item found in it, with
    the smallest edit distance and its first place.

    Null and empty texts and items hold nothing; null ids have no row; repeated rows give one
    row; two items of equal text are both reported; extra columns are ignored."""
    spark = docs.sparkSession
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, distance int, start long"
    out = None
    for block in item_blocks(items, item_col, item_text):
        index = spark.sparkContext.broadcast(ItemIndex(block, similarity, repeats))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = index.value.scan(b.column(1).to_pylist())
                yield pa.record_batch([
                    b.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64())], ["id", "item", "distance", "start"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("id", "item").agg(F.min(F.struct("distance", "start")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.distance", "b.start")


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all columns as they are."""
    name = docs.columns.index(text_col)
    for block in item_blocks(items, item_col, item_text):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block))

        def keep(b: pa.RecordBatch, index=index) -> pa.Array:
            held = {r[0] for r in index.value.scan(b.column(name).to_pylist())}
            return pa.array([i not in held for i in range(b.num_rows)])

        docs = filter_batches(docs, keep)
    return docs
