"""Batched text generation (UDF surface of SURVEY 2.12): any model that maps prompts to texts, built
once per worker, fed by the prompt table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX

#: A generator takes a list of prompts and gives one text per prompt.
Generator = Callable[[list[str]], list[str]]

_CONTEXT = re.compile(r"Context:\n(.*)\n\nQuestion: ", re.DOTALL)
NOT_FOUND = "not found in context"


def lead_generator(max_words: int = 8) -> Generator:
    """Default: echoes the prompt and answers with the first words of its context, so it needs no
    weights and gives the same text every time."""
    def generate(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = _CONTEXT.search(p)
            words = m.group(1).split()[:max_words] if m else []
            out.append(f"{p} {' '.join(words) or NOT_FOUND}")
        return out
    return generate


def build_prompt(context: str | Column, question: str | Column, template: str = C.PROMPT_TEMPLATE) -> Column:
    """TXT-20: the template with ``{ctx}`` and ``{q}`` filled in."""
    pre, rest = template.split("{ctx}")
    mid, post = rest.split("{q}")
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit(pre), col(context), F.lit(mid), col(question), F.lit(post))


def generate(prompts: DataFrame, prompt_col: str, make_generator: Callable[[], Generator] = lead_generator,
             out_col: str = "generated", batch_size: int = 32, unique: bool = True) -> DataFrame:
    """``prompts`` with the generated text per row (null prompt: null).

    ``make_generator`` runs once per Python worker and task; with ``unique`` equal prompts of an Arrow
    batch are generated once.  A generator must be deterministic (no sampling), since a lost task runs
    again; anything but one text per prompt is an error."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_generator()
        for part in parts:
            given = part[part.notna()]
            asked = list(dict.fromkeys(given)) if unique else given.tolist()
            made: list[str] = []
            for i in range(0, len(asked), batch_size):
                texts = list(model(asked[i:i + batch_size]))
                if len(texts) != len(asked[i:i + batch_size]) or not all(isinstance(x, str) for x in texts):
                    raise ValueError("the generator gave no text for some prompt")
                made += texts
            out = pd.Series([None] * len(part), index=part.index, dtype=object)
            known = dict(zip(asked, made, strict=True)) if unique else {}
            out[given.index] = [known[p] for p in given] if unique else made
            yield out

    return prompts.withColumn(out_col, run(F.col(prompt_col)))


def answers(prompts: DataFrame, prompt_col: str, make_generator: Callable[[], Generator] = lead_generator,
            out_col: str = "answer", **kw) -> DataFrame:
    """Generated texts after their last answer mark."""
    return generate(prompts, prompt_col, make_generator, out_col, **kw).withColumn(out_col, TX.answer_after_marker(F.col(out_col)))
