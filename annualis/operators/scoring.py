"""Batched pair scoring for the rerank step (WIN-1): a model is built once per worker and scores
(question, passage) pairs in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A scorer takes equally long lists of questions and passages and gives one number per pair.
Scorer = Callable[[list[str], list[str]], np.ndarray]


def overlap_scorer() -> Scorer:
    """Default: F1 of the word sets of two texts whose words are separated by spaces."""
    def score(questions: list[str], passages: list[str]) -> np.ndarray:
        words: dict[str, frozenset[str]] = {}
        out = np.zeros(len(questions))
        for i, (q, p) in enumerate(zip(questions, passages, strict=True)):
            if q not in words:
                words[q] = frozenset(q.split(" ")) - {""}
            a, b = words[q], frozenset(p.split(" ")) - {""}
            both = len(a & b)
            if both:
                precision, recall = both / len(b), both / len(a)
                out[i] = 2 * precision * recall / (precision + recall)
            elif not a and not b:
                out[i] = 1.0
        return out
    return score


def order_scorer() -> Scorer:
    """Keeps the order of the hits: the same score for every pair."""
    return lambda questions, passages: np.ones(len(questions))


def score_pairs(pairs: DataFrame, question_col: str, text_col: str, make_scorer: Callable[[], Scorer] = overlap_scorer,
                out_col: str = "ce_score", batch_size: int = 256) -> DataFrame:
    """``pairs`` with a score per row; null texts count as empty.

    ``make_scorer`` runs once per Python worker and task, ``batch_size`` pairs are scored at a
    time.  A scorer must be deterministic: a lost task is run again.  Anything but one finite
    number per pair is an error."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for questions, passages in parts:
            q, p = questions.fillna("").tolist(), passages.fillna("").tolist()
            found = [np.asarray(scorer(q[i:i + batch_size], p[i:i + batch_size]), float) for i in range(0, len(q), batch_size)]
            out = np.concatenate(found) if found else np.zeros(0)
            if out.shape != (len(q),) or not np.isfinite(out).all():
                raise ValueError("the scorer gave no finite number for some pair")
            yield pd.Series(out)

    return pairs.withColumn(out_col, score(F.col(question_col), F.col(text_col)))
