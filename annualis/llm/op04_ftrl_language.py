"""Language identification by sparse multinomial logistic regression on TF-IDF n-grams.

Features are the 1- to 3-letter n-grams of the lower-cased words, with a mark at both word
ends, hashed into buckets; the value of one is its share of the text's n-grams times the
inverse document frequency of its bucket.  Document frequencies are counted over all
training documents.  Weights are fitted on a bounded sample by follow-the-regularised-leader
with elastic-net penalties, so most are exactly zero, and a temperature for the
probabilities is chosen on sampled rows that the fit has not seen.

Many texts are read at once as one array of code points, in which every run of other characters
than letters becomes one mark; n-grams are then neighbours in that array, and the logits, which
are linear in the n-gram counts, are sums of table rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annualis.llm.common import filter_batches, held_out, slices_by_size

UNDETERMINED = "und"
#: Rows of each language that the model is fitted on, about (a hash decides which).
MAX_TRAIN_PER_LANGUAGE = 1_500
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
EPOCHS, BATCH = 4, 32
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.5
#: Constant factor of all features, which makes a text's feature vector about one long.
SCALE = 10.0
#: One sampled row in so many chooses the temperature.
CALIBRATION = 5
#: Documents of this probability or more are kept by the filter.
LEAST_SCORE = 0.4
#: Characters of texts read at once (a longer text alone), places hashed at once, texts counted at once.
_CHARS, _PLACES, _TEXTS = 1 << 19, 1 << 19, 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Added per order, so that an n-gram and a longer one that begins with it part.
_ORDER = tuple(np.uint64(x) for x in (0x632BE59BD9B4E019, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram of the texts, in blocks; a text's n-grams come in the same
    order whatever texts are beside it."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a word is its mark, and the next word's
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in low])[keep]
    letter = np.concatenate([[False], letter[keep], [False]])
    v = np.zeros(len(letter), np.uint64)
    v[1:-1] = code[keep]
    v[~letter] = 0
    for i in range(0, len(owner), _PLACES):
        n = min(_PLACES, len(owner) - i)
        before, here, after = v[i:i + n], v[i + 1:i + n + 1], v[i + 2:i + n + 2]
        is_letter, own = letter[i + 1:i + n + 1], owner[i:i + n]
        pair = before | here << np.uint64(21)
        # a pair that ends in a letter or follows one; it belongs to the text of its letter
        paired = is_letter | letter[i:i + n]
        single, triple = here[is_letter], (pair | after << np.uint64(42))[is_letter]
        own1 = own[is_letter]
        yield (np.concatenate([own1, own[paired], own1]),
               (np.concatenate([single * _GOLD + _ORDER[0], pair[paired] * _GOLD + _ORDER[1], triple * _GOLD + _ORDER[2]])
                >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one text."""
    parts = [b for _, b in gram_buckets([text])]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (buckets x languages)
    bias: np.ndarray
    temperature: float

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts / counts.sum() * self.idf[buckets] * SCALE
        return x @ self.weights[buckets] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(languages, probabilities) of the texts."""
        k = len(self.languages)
        found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not k:
            return found, score
        table = (self.idf[:, None] * self.weights * SCALE).T.copy()
        for s, e in slices_by_size(texts, _CHARS):
            total, n = np.zeros((e - s, k)), np.zeros(e - s)
            for own, bucket in gram_buckets(texts[s:e]):
                n += np.bincount(own, minlength=e - s)
                for j in range(k):
                    total[:, j] += np.bincount(own, table[j][bucket], e - s)
            some = np.flatnonzero(n)
            z = (total[some] / n[some, None] + self.bias) / self.temperature
            p = _softmax(z)
            best = p.argmax(axis=1)
            score[s + some] = p[np.arange(len(some)), best]
            for i, j in zip((s + some).tolist(), best.tolist(), strict=True):
                found[i] = self.languages[j]
        return found, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, languages: list[str], idf: np.ndarray, calibrate: np.ndarray,
        epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Weights by FTRL on the rows (buckets, counts) that ``calibrate`` does not mark, then the
    temperature that suits the marked ones best."""
    k = len(languages)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    bias, bias_n = np.zeros(k), np.ones(k)
    values = [c / c.sum() * idf[b] * SCALE for b, c in rows]
    rng = np.random.default_rng(seed)
    fitted = np.flatnonzero(~calibrate) if (~calibrate).any() else np.arange(len(rows))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    for _ in range(epochs):
        order = rng.permutation(fitted)
        for s in range(0, len(order), BATCH):
            part = order[s:s + BATCH]
            idx = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([values[i] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            used, at = np.unique(idx, return_inverse=True)
            w = weights(z[used], n[used])
            logit = np.stack([np.bincount(doc, x * w[at, j], len(part)) for j in range(k)], axis=1) + bias
            err = _softmax(logit)
            err[np.arange(len(part)), target[part]] -= 1
            g = np.stack([np.bincount(at, x * err[doc, j], len(used)) for j in range(k)], axis=1)
            n2 = n[used] + g * g
            z[used] += g - (np.sqrt(n2) - np.sqrt(n[used])) / ALPHA * w
            n[used] = n2
            gb = err.sum(axis=0)
            bias_n += gb * gb
            bias -= 0.1 * gb / np.sqrt(bias_n)
    model = Model(languages, idf, weights(z, n), bias, 1.0)
    check = np.flatnonzero(calibrate)
    if len(check):
        logit = np.stack([model.logits(*rows[i]) for i in check])
        own = logit[np.arange(len(check)), target[check]]

        def loss(t: float) -> float:
            a = logit / t
            top = a.max(axis=1)
            return float((top + np.log(np.exp(a - top[:, None]).sum(axis=1)) - own / t).mean())

        model.temperature = min(np.geomspace(0.05, 5.0, 93).tolist(), key=loss)
    return model


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """(documents, documents holding each bucket) of the whole table: counts per task, added by
    Spark; at most one number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, seen = 0, np.zeros(BUCKETS, np.int64), np.zeros((_TEXTS, BUCKETS), bool)
        for b in batches:
            texts = b.column(0).to_pylist()
            n += len(texts)
            for s, e in slices_by_size(texts, _CHARS):
                for i in range(s, e, _TEXTS):
                    seen[:] = False
                    for own, bucket in gram_buckets(texts[i:min(i + _TEXTS, e)]):
                        seen[own, bucket] = True
                    df += np.count_nonzero(seen, axis=0)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["bucket", "n"])

    got = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df, total = np.zeros(BUCKETS, np.int64), 0
    for b, n in zip(got.column("bucket").to_pylist(), got.column("n").to_pylist(), strict=True):
        if b < 0:
            total = n
        else:
            df[b] = n
    return total, df


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = MAX_TRAIN_PER_LANGUAGE) -> Model:
    """A model learned from text and non-null language of the rows that are not held out:
    document frequencies from all of them, weights from about ``per_language`` of each."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    total, df = document_frequencies(known, "text")
    idf = np.log((1 + total) / (1 + df)) + 1
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(parts, parts * per_language // counts[lang] + 1))])
    place = F.pmod(F.xxhash64("id"), F.lit(parts))
    sample = known.where(place < share[F.col("lang")]).select("id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.stack(gram_counts(t)).astype(np.uint32).tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "lang", "grams"])

    got = sample.mapInArrow(run, "id long, lang string, grams binary").toArrow().sort_by([("id", "ascending"), ("grams", "ascending")])
    rows, target, checks = [], [], []
    for i, lang, g in zip(*(got.column(c).to_pylist() for c in ("id", "lang", "grams")), strict=True):
        if g:
            u, c = np.frombuffer(g, np.uint32).reshape(2, -1)
            rows.append((u.astype(np.int64), c.astype(float)))
            target.append(languages.index(lang))
            checks.append(zlib.crc32(b"calibrate %d" % i) % CALIBRATION == 0)
    if not rows:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    return fit(rows, np.array(target), languages, idf, np.array(checks))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score): one row per input row, repeated rows included.

    Texts that are null or have no letter are ``und`` with score 0, and so is every text
    where nothing could be learned; extra columns are ignored."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = known.value.predict(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)],
                                  ["id", "held_out", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a determined language of probability ``least`` or more."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(b: pa.RecordBatch) -> pa.Array:
        lang, score = known.value.predict(b.column(at).to_pylist())
        return pa.array([x != UNDETERMINED and p >= least for x, p in zip(lang, score.tolist(), strict=True)])

    return filter_batches(docs, keep)
