"""Registered selection queries: heuristic select, features, segment drivers, eval set,
training rows, answer groups and the learned selector."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators import extract as EX
from annualis.operators import select as SL
from annualis.plans.pipeline import contexts_sql, question_candidates, question_contexts, scored_filings
from annualis.plans.q_extract import CANDS_SQL, _q, canonicalize_sql, candidates_sql
from annualis.plans.registry import register
from annualis.session import cut_lineage
from annualis.sources.tables import FILINGS_V_SQL, Q_V_SQL, filings

ALIGNED_SQL = "coalesce(len(list_intersect(subj_groups, cand_groups)) > 0, false)"


def select_sql(src: str, hint: str | None = None) -> str:
    """CTEs from candidates ``src`` to ``pick`` (rn = 1 is the selected candidate)."""
    h = ""
    base = src
    if hint:
        h = f"""h1 AS (SELECT *, coalesce(list_contains(cand_groups, {hint}), false) AS hh FROM {src}),
h2 AS (SELECT * FROM (SELECT *, max(CASE WHEN hh THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anyh FROM h1) WHERE hh OR anyh = 0),
"""
        base = "h2"
    return f"""{h}c1 AS (SELECT *, (len(subj_groups) > 0 AND {ALIGNED_SQL}) AS al, {ALIGNED_SQL} AS aligned FROM {base}),
c2 AS (SELECT *, max(CASE WHEN coalesce(category, '') <> 'revenue_driver' OR al THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anyf FROM c1),
c3 AS (SELECT * FROM c2 WHERE coalesce(category, '') <> 'revenue_driver' OR al OR anyf = 0),
pick AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY aligned DESC, ce_score DESC, ctx_rank, sent_pos, patt_pos) AS rn FROM c3)"""


def _q_cands(spark, sf, scored=None):
    return question_candidates(spark, sf, scored=scored)


@register("select_heuristic", f"""{CANDS_SQL},
{select_sql('cands')}
SELECT qid, phrase, ctx_rank, sent_pos, patt_pos FROM pick WHERE rn = 1""")
def select_heuristic(spark, sf):
    """SEL-2 / WIN-9: heuristic choice among each question's candidates."""
    return SL.select_heuristic(_q_cands(spark, sf)).select("qid", "phrase", "ctx_rank", "sent_pos", "patt_pos")


def features_sql(src: str) -> str:
    groups = ", ".join(f"CAST(list_contains(cand_groups, '{g}') AS DOUBLE) AS g_{g}" for g in C.GROUP_NAMES)
    return f"""SELECT qid, ctx_rank, sent_pos, patt_pos, 1.0 AS bias, CAST(ctx_rank AS DOUBLE) AS ctx_rank_f,
  round(1.0 / (1 + ctx_rank), 6) AS ctx_rank_inv, CAST(ce_score AS DOUBLE) AS ce_score,
  CAST(CASE WHEN phrase = '' THEN 0 ELSE len(string_split_regex(phrase, '\\s+')) END AS DOUBLE) AS len_words,
  CAST(len(subj_groups) > 0 AS DOUBLE) AS subj_any, {groups},
  CAST({ALIGNED_SQL} AS DOUBLE) AS align,
  CAST(coalesce(category, '') = 'revenue_driver' AS DOUBLE) AS cat_rev,
  CAST(coalesce(category, '') = 'margin_driver' AS DOUBLE) AS cat_margin,
  CAST(coalesce(category, '') = 'opex_driver' AS DOUBLE) AS cat_opex FROM {src}"""


@register("features", f"""{CANDS_SQL}
{features_sql('cands')}""")
def features(spark, sf):
    """SEL-1: the 16 selector features of every candidate."""
    f = SL.features(_q_cands(spark, sf))
    names = {n: ("ctx_rank_f" if n == "ctx_rank" else n) for n in C.FEATURE_NAMES}
    return f.select("qid", "ctx_rank", "sent_pos", "patt_pos",
                    *[F.round(F.col(SL.FEATURE_PREFIX + n), 6).alias(names[n]) for n in C.FEATURE_NAMES])


@register("segment_drivers", f"""{CANDS_SQL},
ord AS (SELECT *, {ALIGNED_SQL} AS aligned FROM cands),
best_all AS (SELECT qid, phrase AS overall FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY aligned DESC,
  ce_score DESC, ctx_rank, sent_pos, patt_pos) AS rn FROM ord) WHERE rn = 1),
segs(segment) AS (VALUES {', '.join(f"('{g}')" for g in C.SEGMENTS)}),
per_seg AS (SELECT o.*, s.segment FROM ord o JOIN segs s ON list_contains(o.cand_groups, s.segment)),
best_seg AS (SELECT qid, segment, phrase AS seg_phrase FROM (SELECT *, row_number() OVER (PARTITION BY qid, segment
  ORDER BY aligned DESC, ce_score DESC, ctx_rank, sent_pos, patt_pos) AS rn FROM per_seg) WHERE rn = 1)
SELECT b.qid, s.segment, coalesce(bs.seg_phrase, b.overall) AS phrase, CAST(bs.seg_phrase IS NOT NULL AS INTEGER) AS from_segment
FROM best_all b CROSS JOIN segs s LEFT JOIN best_seg bs ON bs.qid = b.qid AND bs.segment = s.segment""")
def segment_drivers(spark, sf):
    """JN-13: driver per (question, segment): best candidate of the segment's group, else the overall best."""
    return SL.segment_drivers(_q_cands(spark, sf))


def eval_items_sql() -> str:
    seeds = ", ".join(f"('{cat}', {_q(k.lower().strip())}, {ci}, {ki})"
                      for ci, (cat, keys) in enumerate(C.EVAL_SEED_KEYS.items()) for ki, k in enumerate(keys))
    anchor = " ".join(f"WHEN '{cat}' THEN regexp_matches(lower(ch.text), {_q('(?i)' + C.CATEGORY_REGEX[cat])})"
                      for cat in C.EVAL_SEED_KEYS)
    qs = " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in C.QUESTIONS.items())
    return f"""ch AS (SELECT doc_id AS chunk_id, doc_id, company, year, coalesce(text, '') AS text FROM filings_v
  WHERE regexp_matches(coalesce(text, ''), {_q('(?i)' + C.CUE_ANY)})),
seeds(category, answer, ci, ki) AS (VALUES {seeds}),
er AS (SELECT ch.chunk_id, ch.doc_id, ch.company, ch.year, s.category, s.answer, s.ci, s.ki FROM ch JOIN seeds s
  ON (CASE s.category {anchor} END) AND contains(lower(ch.text), s.answer)),
e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, year, category, answer ORDER BY chunk_id, ci, ki) AS r1 FROM er) WHERE r1 = 1),
e2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, year, category ORDER BY chunk_id, ci, ki) AS r2 FROM e1) WHERE r2 <= 6),
items AS (SELECT company || '|' || CAST(year AS VARCHAR) || '|' || category || '|' || answer AS qid,
  CASE category {qs} END AS question, company, CAST(year AS INTEGER) AS year, category, answer, chunk_id, doc_id FROM e2)"""


def _items(spark, sf):
    """The evaluation items, found once: a few per company, year and category, read several times."""
    fil = filings(spark, sf).withColumn("chunk_id", F.col("doc_id"))
    return cut_lineage(SL.eval_items(fil))


@register("eval_set", f"""WITH {FILINGS_V_SQL},
{eval_items_sql()}
SELECT qid AS item_id, question, company, year, category, answer, chunk_id, doc_id FROM items""")
def eval_set(spark, sf):
    """SEL-8 + FLT-3 + AGG-7 + WIN-8: generated driver QA items from the filings (years 2021-2023)."""
    return _items(spark, sf)


@register("answer_groups", f"""WITH {FILINGS_V_SQL},
{eval_items_sql()},
cn AS (SELECT qid, {canonicalize_sql('answer')} AS can FROM items)
SELECT qid AS item_id, can AS answer_canonical, CASE {' '.join(
    "WHEN " + " OR ".join(f"contains(can, {_q(s)})" for s in subs) + f" THEN '{g}'" for g, subs in C.ANSWER_GROUPS)} END AS answer_group
FROM cn""")
def answer_groups(spark, sf):
    """SEL-6 + TXT-15: canonical gold answer of every eval item and its answer group."""
    it = _items(spark, sf)
    can = TX.canonicalize(F.col("answer"))
    return it.select("item_id", can.alias("answer_canonical"), SL.answer_group(can).alias("answer_group"))


def _item_cands(spark, sf, scored=None):
    it = _items(spark, sf).withColumnRenamed("item_id", "qid")
    return question_candidates(spark, sf, qv=it.select("qid", "category", "company", "year", "answer"),
                               priority="substring", keep=["answer"], scored=scored)


TRAIN_SQL = f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
{eval_items_sql()},
{contexts_sql('items', 'substring')},
{candidates_sql('ctx', 'qid, doc_id', 'category')},
lab AS (SELECT c.*, i.answer, CAST({canonicalize_sql('c.phrase')} = {canonicalize_sql('i.answer')} AS INTEGER) AS label
  FROM cands c JOIN items i ON i.qid = c.qid),
tr AS (SELECT * FROM (SELECT *, max(label) OVER (PARTITION BY qid) AS anypos FROM lab) WHERE anypos = 1)"""


@register("train_rows", f"""{TRAIN_SQL}
SELECT qid, ctx_rank, sent_pos, patt_pos, phrase, label FROM tr""")
def train_rows(spark, sf):
    """SEL-4: candidates of each eval item's 5 contexts (training priority), labelled by
    canonical match with the gold answer; items without a positive dropped."""
    lab = SL.label_candidates(_item_cands(spark, sf))
    return lab.select("qid", "ctx_rank", "sent_pos", "patt_pos", "phrase", "label")


@register("selector_scores")
def selector_scores(spark, sf):
    """SEL-5 + SEL-3 + WIN-10: train the balanced logistic selector on the training rows,
    score every question's candidates, pick the argmax.  (Iterative fit: rows-only check.)"""
    scored = scored_filings(spark, sf)
    rows = cut_lineage(SL.features(SL.label_candidates(_item_cands(spark, sf, scored))))
    model = SL.train_selector(rows)
    cands = SL.features(_q_cands(spark, sf, scored))
    if model is None:  # no training data: heuristic path
        return SL.select_heuristic(cands).select("qid", "phrase", F.lit(None).cast("double").alias("p"))
    pick = SL.argmax_pick(SL.score_candidates(model, cands))
    return pick.select("qid", "phrase", F.round("p", 6).alias("p"))


# Weights of a stored selector, in feature order, and its intercept.
STORED_WEIGHTS = [0.0, -0.31, 0.82, 1.4, -0.07, 0.55, 0.21, 0.13, -0.18, -0.26, 0.34, 0.09, 1.9, 0.12, -0.05, 0.03]
STORED_INTERCEPT = -0.45
_FEATURE_NAMES_SQL = ["ctx_rank_f" if n == "ctx_rank" else n for n in C.FEATURE_NAMES]


@register("stored_selector_pick", f"""{CANDS_SQL},
f AS ({features_sql('cands').replace('round(1.0 / (1 + ctx_rank), 6)', '1.0 / (1 + ctx_rank)')
      .replace('SELECT qid,', 'SELECT qid, phrase,', 1)}),
p AS (SELECT *, 1.0 / (1.0 + exp(-({STORED_INTERCEPT} + {" + ".join(f"({w}) * {n}" for w, n in zip(STORED_WEIGHTS, _FEATURE_NAMES_SQL, strict=True))}))) AS p FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, ctx_rank, sent_pos, patt_pos) AS rn FROM p)
SELECT qid, phrase, ctx_rank, round(p, 6) AS p FROM r WHERE rn = 1""")
def stored_selector_pick(spark, sf):
    """SEL-3 + WIN-10: candidates scored with stored selector weights, the likeliest of each question."""
    scored = SL.score_linear(SL.features(_q_cands(spark, sf)), STORED_WEIGHTS, STORED_INTERCEPT)
    return SL.argmax_pick(scored).select("qid", "phrase", "ctx_rank", F.round("p", 6).alias("p"))


@register("sample_items", f"""WITH {FILINGS_V_SQL},
{eval_items_sql()}
SELECT qid AS item_id, md5(qid || '|42') AS shuffle_key FROM items ORDER BY shuffle_key, qid LIMIT 10""")
def sample_items(spark, sf):
    """WIN-12: repeatable (seeded) shuffle of the eval items, then the first 10 (a sampling operator)."""
    from annualis.operators import rank as R
    return R.seeded_shuffle_limit(_items(spark, sf), "item_id", 10).select("item_id", "shuffle_key")


@register("selector_accuracy")
def selector_accuracy(spark, sf):
    """AGG-10: binary accuracy (p >= 0.5 against the label) of the trained selector on its
    training rows; no rows -> 0.  (Iterative fit: rows-only check.)"""
    rows = cut_lineage(SL.features(SL.label_candidates(_item_cands(spark, sf))))
    model = SL.train_selector(rows)
    if model is None:
        return spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("accuracy"))
    scored = SL.score_candidates(model, rows)
    return scored.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double")),
                                 F.lit(0.0)).alias("accuracy"))
