"""Near-duplicate classes by ProbMinHash over weighted word shingles.

A document is the multiset of its five-word shingles (lower-cased words; a text of one to
four words is one shingle).  Every shingle is a Poisson process whose rate is its count;
register j of the signature holds the shingle whose arrival at j is first, so two documents
agree in a register with probability J_P, the probability Jaccard of their counts.
Processes stop early, as soon as their next arrival is later than every register.

Registers are cut into bands; documents that agree in a whole band share a bucket.  Inside a
bucket links are verified exactly (J_P of the real counts >= threshold):

1. every member against the bucket's smallest member (a star, linear in the bucket);
2. where a bucket still spans several components: its members against a few heads, one of each
   other component a member meets (linear again);
3. where it spans several even then, the members outside its largest component (the strays)
   against each other and against that component, in blocks of bounded size spread over the
   tasks; a stray meets a component once, however many buckets they share.

So a bucket with a third of all rows costs stars, not its square, and no link between two
components that share a bucket is lost.  Exact copies (equal word sequences) are folded before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import WORD, slices_by_size, written
from annualis.llm.components import connected_components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Heads of a bucket in each further star round, number of these rounds, members of a tile.
HEADS, ROUNDS, BLOCK = 8, 1, 128
#: Shingles up to which a document's set is kept as a Python set.
SMALL = 4_000
_WORD_CACHE = 400_000

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x = x ^ (x >> _U(27))
    x = x * _M2
    return x ^ (x >> _U(31))


class Shingler:
    """Texts to (owner, shingle hash, count) arrays; word hashes are kept in a bounded cache."""

    def __init__(self, width: int = SHINGLE_WORDS):
        self.width, self.cache = width, {}

    def word_hashes(self, text: str) -> np.ndarray:
        cache = self.cache
        if len(cache) > _WORD_CACHE:
            cache.clear()
        words = WORD.findall(text.lower())
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """One hash per window of ``width`` words (fewer words: one window of them all)."""
        n = len(words)
        if not n:
            return words
        k = min(self.width, n)
        h = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            h = _mix(h * _GOLD + words[j:n - k + 1 + j] + _U(j + 1))
        return h

    def counted(self, text: str | None) -> "Counted":
        s = self.shingles(self.word_hashes(text or ""))
        return Counted(*np.unique(s, return_counts=True)) if len(s) else Counted(s, s.astype(np.int64))


class Counted:
    """Distinct shingles, ascending, with their counts; also a set if they are few and none repeats."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        self.shingles, self.counts = shingles, counts
        self.plain = frozenset(shingles.tolist()) if 0 < len(counts) <= SMALL and counts.max() == 1 else None


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int):
    """ProbMinHash of ``docs`` documents at once: (docs x registers) winning shingles.

    Round r draws the r-th arrival of every process that is still alive: an exponential
    waiting time at the shingle's rate and a uniformly drawn register.  A process dies when
    its time passes the latest register of its document (early termination)."""
    time = np.full(docs * registers, np.inf)
    win = np.zeros(docs * registers, dtype=np.uint64)
    at = np.zeros(len(shingle))
    state = _mix(shingle + _GOLD)
    base = owner * registers
    while len(shingle):
        state = state + _GOLD
        draw = _mix(state)
        u = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        at = at - np.log(u) / weight
        reg = base + ((_mix(draw) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        early = at < time[reg]
        r, t = reg[early], at[early]
        np.minimum.at(time, r, t)
        best = t == time[r]
        win[r[best]] = shingle[early][best]
        latest = time.reshape(docs, registers).max(axis=1)
        live = at < latest[base // registers]
        shingle, weight, at, state, base = shingle[live], weight[live], at[live], state[live], base[live]
    return win.reshape(docs, registers)


def band_keys(win: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(win), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    cut = win.reshape(len(win), bands, rows)
    for j in range(rows):
        h = _mix(h * _GOLD + cut[:, :, j])
    return h.view(np.int64)


def probability_jaccard(a: Counted, b: Counted) -> float:
    """Exact J_P of two counted shingle sets: sum over shared i of
    1 / sum_j max(x_j / x_i, y_j / y_i), by sorting the shared ones on x_i / y_i.
    Without repeated shingles that is the Jaccard similarity of the sets."""
    if a.plain and b.plain:
        both = len(a.plain & b.plain)
        return both / (len(a.plain) + len(b.plain) - both)
    if not len(a.shingles) or not len(b.shingles):
        return 0.0
    _, ia, ib = np.intersect1d(a.shingles, b.shingles, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a.counts[ia].astype(float), b.counts[ib].astype(float)
    only_x, only_y = a.counts.sum() - x.sum(), b.counts.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # j up to i in this order (x_j / y_j <= x_i / y_i): y_j / y_i is the larger one
    below_y, above_x = np.cumsum(y) + only_y, x.sum() - np.cumsum(x) + only_x
    return float((1.0 / (below_y / y + above_x / x)).sum())


def similar(a: Counted, b: Counted, threshold: float) -> bool:
    if a.plain and b.plain and min(len(a.plain), len(b.plain)) < threshold * max(len(a.plain), len(b.plain)):
        return False
    return probability_jaccard(a, b) >= threshold


def _signed(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler(width)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for s, e in slices_by_size(texts):
                words = [sh.word_hashes(t or "") for t in texts[s:e]]
                counted = [np.unique(x, return_counts=True) for x in map(sh.shingles, words)]
                n = np.array([len(c[0]) for c in counted])
                full = np.flatnonzero(n)
                keys, copies = [], [None] * (e - s)
                if len(full):
                    h = np.concatenate([counted[i][0] for i in full])
                    w = np.concatenate([counted[i][1] for i in full]).astype(float)
                    win = signatures(np.repeat(np.arange(len(full)), n[full]), h, w, len(full), bands * rows)
                    keys = band_keys(win, bands, rows).tolist()
                out: list = [None] * (e - s)
                for i, k in zip(full, keys, strict=True):
                    out[i], copies[i] = k, xxhash.xxh128_digest(words[i].tobytes())
                yield pa.record_batch([ids.slice(s, e - s), pa.array(copies, pa.binary()),
                                       pa.array(out, pa.list_(pa.int64()))], ["id", "copy", "keys"])

    return docs.mapInArrow(run, "id long, copy binary, keys array<long>")


def _linked_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, width: int, block: int) -> DataFrame:
    """The pairs (a, b) whose exact J_P reaches the threshold; b is often the head of many.

    The pairs of a head are cut into parts of about ``block``; parts are dealt out into bins
    of about four blocks, and every part has the text of its head once."""
    pairs = written(pairs, "pairs")
    bins = max(1, -(-pairs.count() // (4 * block)))
    per = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("parts"))
    place = lambda part: F.pmod(F.xxhash64("b", part), F.lit(bins)).alias("bin")
    member = pairs.join(per, "b").select(place(F.pmod(F.xxhash64("a"), F.col("parts"))), "b", F.col("a").alias("id"))
    parts = per.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    head = parts.select(place(F.col("part")), "b", F.col("b").alias("id")).distinct()
    rows = member.unionAll(head).join(texts.select("id", "text"), "id")

    def run(table: pa.Table) -> pa.Table:
        sh = Shingler(width)
        rows = table.select(["b", "id", "text"]).to_pylist()
        heads = {r["b"]: sh.counted(r["text"]) for r in rows if r["id"] == r["b"]}
        out = [(r["id"], r["b"]) for r in rows if r["id"] != r["b"] and similar(sh.counted(r["text"]), heads[r["b"]], threshold)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    dealt = rows.repartition(-(-bins // 8), "bin").groupBy("bin")
    return written(dealt.applyInArrow(run, "a long, b long"), "stars")


def _block_links(members: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between members of different components in blocks (inner, place, i, j): tiles i
    and j of a bucket's strays (``inner``; place is the bucket, and a pair that shares several
    buckets is tested in the first), or tile i of the strays against tile j of the component
    ``place``.  Links already implied inside the block are not tested."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        inner, place, i, j = (k.as_py() for k in key)
        rows = table.select(["id", "component", "stray", "tile", "keys", "text"]).to_pylist()
        sh = Shingler(width)
        counted = [sh.counted(r["text"]) for r in rows]
        root = {r["component"]: r["component"] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        out = []
        first = [n for n, r in enumerate(rows) if (r["tile"] == i if inner else r["stray"])]
        second = [n for n, r in enumerate(rows) if (r["tile"] == j if inner else not r["stray"])]
        for n in first:
            p, own, top = rows[n], counted[n], find(rows[n]["component"])
            for m in second:
                if inner and i == j and m >= n:
                    break
                q = rows[m]
                if find(q["component"]) == top:
                    continue
                if inner and next(k for k, x in zip(p["keys"], q["keys"], strict=True) if k == x) != place:
                    continue
                if similar(own, counted[m], threshold):
                    out.append((p["id"], q["id"]))
                    root[top] = top = find(q["component"])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy("inner", "place", "i", "j").applyInArrow(run, "a long, b long")


def _open_members(shared: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, node, component of the buckets of three or more that span several components."""
    placed = shared.where("n > 2").join(found, F.col("node") == F.col("id"), "left") \
        .select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    return placed.join(several.select("bucket"), "bucket")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """The members of open buckets in the blocks they are compared in."""
    per = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")) \
        .select("bucket", F.col("top.component").alias("major"), (F.col("n") - F.col("top.n")).alias("strays"))
    m = members.join(per, "bucket").withColumn("stray", F.col("component") != F.col("major"))
    tiles = lambda n: F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    at = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    tile, head = F.col("tile"), ["inner", "place", "node", "component", "stray", "tile"]

    inner = m.where("stray").withColumns({"inner": F.lit(True), "place": F.col("bucket"), "n": tiles(F.col("strays"))})
    inner = inner.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n")))
    inner = inner.select(*head, F.inline(F.transform(each(F.col("n")), lambda j: at(F.least(tile, j), F.greatest(tile, j)))))

    outer = m.select(F.lit(False).alias("inner"), F.col("major").alias("place"), "node", "component", "stray").distinct()
    sizes = outer.groupBy("place").agg(F.count_if("stray").alias("strays"), F.count_if(~F.col("stray")).alias("others")) \
        .select("place", tiles(F.col("strays")).alias("strays"), tiles(F.col("others")).alias("others"))
    outer = outer.join(sizes, "place").withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.when(F.col("stray"), F.col("strays")).otherwise(F.col("others"))))
    outer = outer.select(*head, F.inline(F.when(F.col("stray"), F.transform(each(F.col("others")), lambda j: at(tile, j)))
                                         .otherwise(F.transform(each(F.col("strays")), lambda i: at(i, tile)))))
    return inner.unionAll(outer)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """(id_col, class_id, kept): one row per distinct non-null id.

    class_id is the smallest id of the class (copies and everything reachable by links of
    J_P >= threshold); kept is ``id = class_id``.  Null, empty and word-free texts link with
    nothing; repeated rows are one row; an id with several texts stands for the largest of
    them; rows with a null id have no row in the result.  Extra columns are ignored."""
    docs = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(_signed(docs, bands, rows, width), "signed")
    texts_of = signed.groupBy("id").agg(F.countDistinct(F.coalesce("copy", F.lit(b""))).alias("n"))
    if texts_of.where("n > 1").limit(1).count():
        docs = docs.groupBy("id").agg(F.max("text").alias("text"))
        signed = written(_signed(docs, bands, rows, width), "signed")
    copies = written(signed.where("copy is not null").groupBy("copy")
                     .agg(F.min("id").alias("node"), F.first("keys").alias("keys")), "copies")
    member = signed.join(copies.select("copy", "node"), "copy", "left") \
        .select("id", F.coalesce("node", "id").alias("node")).distinct()
    entry = copies.select("node", F.explode("keys").alias("bucket"))
    heads = entry.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(entry.join(heads, "bucket"), "buckets")
    text = docs.join(shared.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    text = text.groupBy("id").agg(F.max("text").alias("text"))
    text = written(text.join(copies.select(F.col("node").alias("id"), "keys"), "id"), "texts")
    stars = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = _linked_pairs(stars, text, threshold, width, block)
    found = connected_components(links)
    for turn in range(ROUNDS):
        members = written(_open_members(shared, found), "open")
        if not members.limit(1).count():
            break
        spread = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HEADS))
        heads = members.groupBy("bucket", spread.alias("_")).agg(F.min(F.struct("node", "component")).alias("head"))
        # one head of each other component a node meets, however many buckets they share
        more = members.join(heads, "bucket").where("component <> head.component") \
            .groupBy(F.col("node").alias("a"), F.col("head.component").alias("_")).agg(F.min("head.node").alias("b"))
        stars = more.select("a", "b").join(stars, ["a", "b"], "left_anti")
        links = links.unionAll(_linked_pairs(stars, text, threshold, width, block))
        found = connected_components(links)
    members = written(_open_members(shared, found), "open")
    if members.limit(1).count():
        blocks = written(_blocks(members, block).withColumnRenamed("node", "id"), "blocks")
        tasks = -(-blocks.count() // (4 * block))
        blocks = blocks.join(text, "id").repartition(tasks, "inner", "place", "i", "j")
        links = links.unionAll(written(_block_links(blocks, threshold, width), "strays"))
        found = connected_components(links)
    found = found.select(F.col("id").alias("node"), "component")
    out = member.join(found, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("component", "node").alias("class_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("class_id"))
