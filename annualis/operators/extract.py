"""Phrase extraction: candidates with anchor proximity and group tags (EXT-3/4, JN-10),
first-hit phrase over ranked contexts (EXT-1), company driver lookup (EXT-2),
keyword presence score (JN-11) and the category predicates (FLT-4/5).

Everything is a native expression over one sentence or one context row; the only
grouping is per question over its few ranked contexts (bounded by the context cut).
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.session import bounded_broadcast

# Token pattern of the proximity rule (Python's \w+|\S with Unicode word characters).
PROX_TOKEN_RE = r"[\p{L}\p{N}_]+|\S"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cue_regex(cue: str) -> str:
    """Leftmost match of ``cue`` + phrase + terminator, capturing the text before it."""
    return r"(?is)^(.*?)(" + cue + " )" + C.CANDIDATE_TAIL


def token_index(sentence: Column, pos0: Column) -> Column:
    """Index of the token holding 0-based char ``pos0``; a whitespace char maps to the
    last token of the sentence (max(0, n - 1))."""
    n_all = F.size(F.regexp_extract_all(sentence, F.lit(PROX_TOKEN_RE), F.lit(0)))
    ch = sentence.substr(pos0 + 1, F.lit(1))
    upto = F.size(F.regexp_extract_all(sentence.substr(F.lit(1), pos0 + 1), F.lit(PROX_TOKEN_RE), F.lit(0))) - 1
    return F.when(ch.rlike(r"^\s$") | (ch == ""), F.greatest(n_all - 1, F.lit(0))).otherwise(upto)


def anchor_token_positions(sentence: Column, anchor_re: str) -> Column:
    """Token index of every (non-overlapping, leftmost) anchor match start."""
    rx = "(?i)" + anchor_re
    pieces = F.split(sentence, rx)
    matches = F.regexp_extract_all(sentence, F.lit(rx), F.lit(0))
    lens_p = F.transform(pieces, lambda x: F.length(x))
    lens_m = F.transform(matches, lambda x: F.length(x))

    def start(j):
        before_p = F.aggregate(F.slice(lens_p, 1, j + 1), F.lit(0), lambda a, x: a + x)
        before_m = F.aggregate(F.slice(F.concat(F.array(F.lit(0)), lens_m), 1, j + 1), F.lit(0), lambda a, x: a + x)
        return before_p + before_m

    starts = F.transform(matches, lambda m, j: start(j))
    return F.transform(starts, lambda a: F.size(F.regexp_extract_all(sentence.substr(F.lit(1), a), F.lit(PROX_TOKEN_RE), F.lit(0))))


def anchor_ok(sentence: Column, category: Column, d_start: Column, d_end: Column) -> Column:
    """EXT-3: some anchor of the category lies within its token window of the phrase
    start or end token; unknown / null category passes."""
    out = F.lit(True)
    for cat, (rx, win) in reversed(list(C.ANCHORS.items())):
        pos = anchor_token_positions(sentence, rx)
        ok = F.exists(pos, lambda a: (F.abs(a - d_start) <= win) | (F.abs(a - d_end) <= win))
        out = F.when(category == F.lit(cat), ok).otherwise(out)
    return F.coalesce(out, F.lit(True))


def group_tags(text: Column, groups: dict[str, str]) -> Column:
    """JN-10: names of the groups whose regex occurs in ``text`` (fixed group order)."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?iU)" + rx), F.lit(name)) for name, rx in groups.items()]))


def extract_candidates(contexts: DataFrame, q_key: str = "qid", rank_col: str = "ctx_rank", text_col: str = "text",
                       category_col: str = "category", ce_col: str | None = None,
                       keep: list[str] | None = None) -> DataFrame:
    """EXT-4: context -> sentences -> the first match of each cue pattern -> proximity
    filter -> subject/candidate groups.  Sequence = (ctx_rank, sent_pos, patt_pos)."""
    keep = keep or []
    ce = F.coalesce(F.col(ce_col).cast("double"), F.lit(0.0)) if ce_col else F.lit(0.0)
    sents = contexts.select(q_key, rank_col, category_col, *keep, ce.alias("ce_score"),
                            F.posexplode(TX.sentences(text_col)).alias("sent_pos", "sentence"))
    s = F.col("sentence")
    low = F.lower(s)

    def grp(cue, i):  # cheap substring test first; the regex only runs on sentences with the cue
        return F.when(low.contains(cue + " "), F.regexp_extract(s, cue_regex(cue), i)).otherwise(F.lit(""))

    hits = F.array(*[
        F.struct(F.lit(i).alias("patt_pos"), grp(cue, 1).alias("pre"), grp(cue, 2).alias("cue"), grp(cue, 3).alias("raw"))
        for i, cue in enumerate(C.CANDIDATE_CUES)
    ])
    m = sents.select("*", F.inline(F.filter(hits, lambda h: h["cue"] != "")))
    d0 = F.length("pre") + F.length("cue")
    d1 = d0 + F.length("raw") - 1
    m = m.withColumn("d_start", token_index(s, d0)).withColumn("d_end", token_index(s, d1))
    m = m.filter(anchor_ok(s, F.col(category_col), F.col("d_start"), F.col("d_end")))
    phrase = TX.clean_candidate("raw")
    return m.select(
        q_key, *keep, category_col, F.col(rank_col).cast("int").alias("ctx_rank"), "sent_pos", "patt_pos",
        phrase.alias("phrase"), "sentence", "ce_score",
        group_tags(F.col("pre"), C.SUBJECT_GROUPS).alias("subj_groups"),
        group_tags(phrase, C.CANDIDATE_GROUPS).alias("cand_groups"),
    )


def first_hit_phrase(contexts: DataFrame, q_key: str = "qid", rank_col: str = "ctx_rank", text_col: str = "text",
                     patterns: list[str] | None = None) -> DataFrame:
    """EXT-1: first context (in rank order) where any pattern matches; within it the first
    pattern; group 1 normalised.  An empty normalised phrase still counts as the hit."""
    pats = patterns or C.DRIVER_REGEX
    t = F.col(text_col)
    nonempty = F.coalesce(t, F.lit("")) != ""
    phrase = None
    hit = F.lit(False)
    for p in reversed(pats):
        rx = "(?i)" + p
        ph = TX.normalize_extract(F.regexp_extract(t, rx, 1))
        phrase = ph if phrase is None else F.when(t.rlike(rx), ph).otherwise(phrase)
        hit = hit | t.rlike(rx)
    per_ctx = contexts.select(q_key, rank_col, (nonempty & hit).alias("_hit"), phrase.alias("_phrase"))
    return (per_ctx.filter("_hit").groupBy(q_key)
            .agg(F.min_by("_phrase", F.col(rank_col)).alias("phrase"), F.min(rank_col).alias("hit_rank")))


def keyword_score(text: Column, keywords: list[str] | None = None) -> Column:
    """JN-11: number of distinct segment keywords contained in the lower-cased text."""
    kws = keywords or C.keywords_array()
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in kws), F.lit(0))


def _held(text: Column, rx: str, low: Column) -> Column:
    """Whether ``rx`` occurs, whatever the case; where it is a choice of plain words the text is
    searched for those first, which costs a tenth of the pattern."""
    found = text.rlike("(?i)" + rx)
    words = re.fullmatch(r"(?:\\b)?\(([a-z |]+)\)(?:\\b)?", rx)
    if not words:
        return found
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words.group(1).split("|")]) & found


def category_match(text: Column, category: Column, low: Column | None = None) -> Column:
    """FLT-4: category regex AND a driver cue, case-insensitive; other categories false.  ``low`` is the
    text in lower case, if there is one already."""
    low = F.lower(text) if low is None else low
    cue = text.rlike("(?i)" + C.CUE_ANY)
    out = F.lit(False)
    for cat, rx in C.CATEGORY_REGEX.items():
        out = F.when(category == F.lit(cat), _held(text, rx, low) & cue).otherwise(out)
    return F.coalesce(out, F.lit(False))


def category_match_substring(text: Column, category: Column, low: Column | None = None) -> Column:
    """FLT-5: substring variant used for training; unknown category is true."""
    low = F.lower(text) if low is None else low
    cue = F.lit(False)
    for c in C.TRAIN_CUES:
        cue = cue | F.contains(low, F.lit(c))
    out = F.lit(True)
    for cat, words in C.TRAIN_CATEGORY_WORDS.items():
        anyw = F.lit(False)
        for w in words:
            anyw = anyw | F.contains(low, F.lit(w))
        out = F.when(category == F.lit(cat), anyw & cue).otherwise(out)
    return F.coalesce(out, F.lit(True))


def driver_lookup(lookups: DataFrame, corpus: DataFrame, top_k: int = 8, patterns: list[str] | None = None,
                  q_key: str = "qid") -> DataFrame:
    """EXT-2 (find a company's revenue driver).

    ``lookups``: (q_key, company, year nullable); ``corpus``: (doc_id, company, year, text).
    Company matched case-insensitively on trimmed values; contexts ranked by keyword score
    (stable on corpus order), first max(top_k, 8) kept; first context x pattern whose
    stripped group 1 (trailing whitespace and bullets removed) is non-empty wins; else the
    280-char snippet of the best context; no context -> empty strings.
    """
    pats = patterns or C.DRIVER_REGEX
    corp = corpus.select("doc_id", F.lower(TX.strip_ws(F.col("company").cast("string"))).alias("_co"),
                         F.col("year").alias("_yr"), TX.strip_ws(F.coalesce("text", F.lit(""))).alias("text"))
    lk = lookups.select(q_key, F.lower(TX.strip_ws(F.col("company"))).alias("_co"), F.col("year").alias("_qyr"))
    # lookups are the small side (one row per question): broadcast behind a size check so a
    # company holding a third of the corpus is never a shuffle partition of its own
    ctx = corp.join(bounded_broadcast(lk), "_co", "inner").filter(F.col("_qyr").isNull() | (F.col("_yr") == F.col("_qyr")))
    keep = max(top_k, 8)
    w = Window.partitionBy(q_key).orderBy(F.col("_score").desc(), F.col("doc_id"))
    ctx = (ctx.withColumn("_score", keyword_score(F.col("text")))
           .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep))
    t = F.col("text")
    answer = None
    for p in reversed(pats):
        rx = "(?i)" + p
        ph = F.regexp_replace(TX.strip_ws(F.regexp_extract(t, rx, 1)), r"[\s·•]+$", "")
        ok = t.rlike(rx) & (ph != "")
        answer = F.when(ok, ph).otherwise(answer) if answer is not None else F.when(ok, ph)
    per_ctx = ctx.select(q_key, "_rank", "doc_id", "text", answer.alias("_ans"))
    agg = per_ctx.groupBy(q_key).agg(
        F.min_by(F.struct("_ans", "doc_id"), F.when(F.col("_ans").isNotNull(), F.col("_rank"))).alias("_hit"),
        F.min_by(F.struct("text", "doc_id"), F.col("_rank")).alias("_best"),
    )
    res = lookups.select(q_key).join(agg, q_key, "left")
    return res.select(
        q_key,
        F.coalesce(F.col("_hit._ans"), TX.snippet(F.col("_best.text")), F.lit("")).alias("answer"),
        F.coalesce(F.col("_hit.doc_id"), F.col("_best.doc_id")).alias("context_doc"),
        F.col("_hit._ans").isNotNull().cast("int").alias("matched"),
    )
