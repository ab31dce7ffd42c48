"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words and the 4- to 6-letter beginnings of longer ones (an
insult keeps its stem under other endings), each once, hashed to 32 bits.  The score is
the logistic of  w0 + sum w_i + sum_{i<j} <v_i, v_j>:  the pair part, computed in one pass as
half of (square of the sum - sum of squares), learns what two terms mean together, such
as an insult with the mention of a group, where neither alone is toxic.

Weights are fitted on a bounded sample of labelled rows, for the terms that the sample shows to
be related to the label (most words are not, and would only be learned by heart): the linear
part by follow-the-regularised-leader with an L1 penalty; a term has a vector while its
linear weight is not zero, the vectors are fitted by AdaGrad.  All rows are then scored, whole texts, in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import LETTERS, filter_batches, held_out

#: Labelled rows that the model is fitted on, about (a hash decides which).
MAX_TRAIN = 16_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
FACTORS, EPOCHS, BATCH = 8, 10, 128
#: A term is fitted from so many sampled rows, and from so much evidence (the likelihood ratio
#: statistic G2 of term and label) that it has to do with the label at all.
MIN_DOCS, MIN_G2 = 2, 10.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.5, 0.1
RATE, DECAY = 0.05, 1e-3
_CACHE = 300_000


def word_terms(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:k] + "*") for k in PREFIXES if len(word) > k)]


def text_terms(text: str | None, cache: dict) -> np.ndarray:
    """Distinct hashed terms of a text, ascending."""
    if len(cache) > _CACHE:
        cache.clear()
    out: set[int] = set()
    for w in set(LETTERS.findall((text or "").lower())):
        t = cache.get(w)
        if t is None:
            t = cache[w] = word_terms(w)
        out.update(t)
    return np.sort(np.fromiter(out, np.uint32, len(out)))


@dataclass
class Machine:
    """Fitted weights by hashed term (only terms whose weight or vector is not zero)."""

    bias: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scorer(self):
        """text -> score, with a bounded cache of words."""
        row = {int(t): i for i, t in enumerate(self.terms)}
        cache: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            if len(cache) > _CACHE:
                cache.clear()
            rows: set[int] = set()
            for x in set(LETTERS.findall((text or "").lower())):
                r = cache.get(x)
                if r is None:
                    r = cache[x] = tuple(row[t] for t in word_terms(x) if t in row)
                if r:
                    rows.update(r)
            i = sorted(rows)
            v = self.v[i]
            s = v.sum(axis=0)
            z = self.bias + self.w[i].sum() + 0.5 * float(s @ s - (v * v).sum())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def evidence(docs: np.ndarray, toxic: np.ndarray, rows: int, positive: float) -> np.ndarray:
    """G2 of the two-by-two tables (row has the term, row is toxic)."""
    out = np.zeros(len(docs))
    for seen, of in ((toxic, positive), (docs - toxic, rows - positive)):
        for cell, share in ((seen, docs / rows), (of - seen, 1 - docs / rows)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(cell > 0, 2 * cell * np.log(cell / (of * share)), 0.0)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """A machine fitted on the term sets and 0/1 labels of a sample."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.0
    none = Machine(float(np.log(share / (1 - share))) if share else -4.0, np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, factors)))
    if not len(rows) or labels.min() == labels.max():
        return none
    terms, docs = np.unique(np.concatenate(rows), return_counts=True)
    toxic = np.zeros(len(terms))
    for r, y in zip(rows, labels, strict=True):
        if y:
            toxic[np.searchsorted(terms, r)] += 1
    terms = terms[(docs >= MIN_DOCS) & (evidence(docs, toxic, len(rows), labels.sum()) >= MIN_G2)]
    if not len(terms):
        return none

    def known(r: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(terms, r), len(terms) - 1)
        return at[terms[at] == r]

    rows = [known(r) for r in rows]
    d = len(terms)
    z, n, w = np.zeros(d), np.zeros(d), np.zeros(d)
    v = rng.normal(0, 0.05, (d, factors))
    g2 = np.full((d, factors), 1e-2)
    bias, bias_g2 = none.bias, 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), BATCH):
            part = order[s:s + BATCH]
            size = np.array([len(rows[i]) for i in part])
            idx = np.concatenate([rows[i] for i in part])
            doc = np.repeat(np.arange(len(part)), size)
            used, at = np.unique(idx, return_inverse=True)
            sign = np.sign(z[used])
            w[used] = np.where(np.abs(z[used]) <= L1, 0.0, -(z[used] - sign * L1) / ((BETA + np.sqrt(n[used])) / ALPHA + L2))
            live = w[idx] != 0
            ia, da = idx[live], doc[live]
            va = v[ia]
            total = np.stack([np.bincount(da, va[:, f], len(part)) for f in range(factors)], axis=1)
            pair = 0.5 * ((total * total).sum(axis=1) - np.bincount(da, (va * va).sum(axis=1), len(part)))
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[idx], len(part)) + pair, -40, 40)))
            err = p - labels[part]
            g = np.bincount(at, err[doc], len(used))
            n2 = n[used] + g * g
            z[used] += g - (np.sqrt(n2) - np.sqrt(n[used])) / ALPHA * w[used]
            n[used] = n2
            if len(ia):
                ua, la = np.unique(ia, return_inverse=True)
                grad = err[da][:, None] * (total[da] - va)
                gv = np.stack([np.bincount(la, grad[:, f], len(ua)) for f in range(factors)], axis=1) + DECAY * len(part) * v[ua]
                g2[ua] += gv * gv
                v[ua] -= RATE * gv / np.sqrt(g2[ua])
            gb = err.sum()
            bias_g2 += gb * gb
            bias -= RATE * gb / np.sqrt(bias_g2)
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    keep = w != 0
    return Machine(float(bias), terms[keep], w[keep], v[keep])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_train: int = MAX_TRAIN) -> Machine:
    """A machine fitted on about ``max_train`` rows at most of the labelled, not held-out ones.

    Rows with a null id or label are not labelled; an id with several labels has the largest."""
    given = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    count = given.count()
    parts = 1 << 20
    take = parts if count <= max_train else int(parts * max_train / count)
    sample = given.where(F.pmod(F.xxhash64("id"), F.lit(parts)) < take)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([text_terms(t, cache).tobytes() for t in b.column(2).to_pylist()], pa.binary())],
                                  ["id", "label", "terms"])

    # the sample is at most about max_train rows of two numbers
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = text.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, terms binary")
    got = rows.toArrow().sort_by([("id", "ascending"), ("terms", "ascending")])
    return fit([np.frombuffer(t, np.uint32) for t in got.column("terms").to_pylist()], got.column("label").to_numpy().astype(float))


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted): one row per input row, repeated rows included.

    Null and empty texts have the score of no terms; extra columns are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = known.value.scorer()
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([score(t) for t in b.column(2).to_pylist()], pa.float64())],
                                  ["id", "held_out", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"),
                      F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all columns as they are."""
    known = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)
    scorers: list = []

    def keep(b: pa.RecordBatch) -> pa.Array:
        if not scorers:
            scorers.append(known.value.scorer())
        return pa.array([scorers[0](t) < threshold for t in b.column(at).to_pylist()])

    return filter_batches(docs, keep)
