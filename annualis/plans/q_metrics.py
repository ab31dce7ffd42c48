"""Registered metric queries: per-item evaluation, summaries, per-category rollup and the
request-latency summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis import config as C
from annualis.operators import extract as EX
from annualis.operators import metrics as M
from annualis.operators import select as SL
from annualis.functions import text as TX
from annualis.plans.pipeline import contexts_sql, question_candidates, question_contexts, with_texts
from annualis.plans.q_extract import _first_hit_sql, _q, canonicalize_sql, candidates_sql
from annualis.plans.q_select import _items, eval_items_sql, select_sql
from annualis.plans.q_text import answer_tokens_sql, norm_answer_sql
from annualis.plans.registry import register
from annualis.session import cut_lineage
from annualis.sources.tables import FILINGS_V_SQL, Q_V_SQL, table

# ------------------------------------------------------------------ request latency

LAT_SQL = """WITH r AS (SELECT value AS latency_ms, event_type <> 'error' AS ok FROM events)
SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(coalesce(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END), 0) AS BIGINT) AS failed_requests,
  CASE WHEN count(*) > 0 THEN (count(*) - coalesce(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END), 0)) / count(*) ELSE 0.0 END AS request_success_rate,
  round(coalesce(avg(latency_ms), 0.0), 2) AS all_mean_ms,
  round(coalesce(quantile_cont(latency_ms, 0.5), 0.0), 2) AS all_p50_ms,
  round(coalesce(quantile_cont(latency_ms, 0.95), 0.0), 2) AS all_p95_ms,
  round(coalesce(max(latency_ms), 0.0), 2) AS all_max_ms,
  round(coalesce(avg(latency_ms) FILTER (WHERE ok), 0.0), 2) AS ok_mean_ms,
  round(coalesce(quantile_cont(latency_ms, 0.5) FILTER (WHERE ok), 0.0), 2) AS ok_p50_ms,
  round(coalesce(quantile_cont(latency_ms, 0.95) FILTER (WHERE ok), 0.0), 2) AS ok_p95_ms,
  round(coalesce(max(latency_ms) FILTER (WHERE ok), 0.0), 2) AS ok_max_ms
FROM r"""


def request_log(spark, sf):
    """events as the request log: value = latency in ms, type ``error`` = failed request."""
    ev = table(spark, sf, "events", ["value", "event_type"])
    return ev.select(F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))


@register("latency_summary", LAT_SQL)
def latency_summary(spark, sf):
    """AGG-1..4 + FLT-7: success rate, mean / p50 / p95 / max latency, all vs successful."""
    return M.latency_summary(request_log(spark, sf))


# ------------------------------------------------------------------ evaluation items


def _pred_items(spark, sf):
    """Eval items -> contexts -> candidates -> hinted select, else first-hit phrase."""
    it = _items(spark, sf).withColumnRenamed("item_id", "qid")
    keys = cut_lineage(question_contexts(spark, sf, qv=it.select("qid", "category", "company", "year"), priority="regex", with_text=False))
    ctx = cut_lineage(with_texts(spark, sf, keys))  # at most 5 contexts per item
    gold_can = TX.canonicalize(F.lower("answer"))
    hints = it.select("qid", SL.answer_group(gold_can).alias("hint"))
    cands = question_candidates(spark, sf, keys=keys).join(hints, "qid", "inner")
    sel = SL.select_heuristic(cands, hint_col="hint").select("qid", F.col("phrase").alias("sel"))
    fh = EX.first_hit_phrase(ctx).select("qid", F.col("phrase").alias("fh"))
    ctxs = ctx.groupBy("qid").agg(  # at most 5 contexts per item
        F.transform(F.array_sort(F.collect_list(F.struct("ctx_rank", "text"))), lambda x: x["text"]).alias("contexts"),
        F.collect_list("doc_id").alias("ctx_docs"))
    pred = F.coalesce(F.nullif(F.col("sel"), F.lit("")), F.nullif(F.col("fh"), F.lit("")), F.lit(""))
    base = (it.join(sel, "qid", "left").join(fh, "qid", "left").join(ctxs, "qid", "left")
            .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
            .withColumn("prediction", pred))
    am = M.answer_metrics(F.col("prediction"), F.col("answer"))
    cm = M.context_metrics(F.col("contexts"), F.col("answer"))
    return base.select(
        F.col("qid").alias("item_id"), "category", "prediction",
        F.coalesce(F.array_contains("ctx_docs", F.col("chunk_id")), F.lit(False)).cast("int").alias("recall_at_5"),
        *[v.alias(k) for k, v in am.items()], *[v.alias(k) for k, v in cm.items()])


ROUND6 = ["token_f1", "context_hit_rate", "reciprocal_rank", "avg_context_len_tokens"]
ITEM_COLS = ["item_id", "category", "prediction", "recall_at_5", "exact_match", "contains_match", "token_f1",
             "em_raw", "em_canonical", "em_contains", "answer_len_tokens", "retrieval_hit", "context_hit_rate",
             "first_hit_rank", "reciprocal_rank", "hit_at_1", "hit_at_3", "hit_at_5", "avg_context_len_tokens"]


def _items_sql() -> str:
    groups = " ".join("WHEN " + " OR ".join(f"contains(gc, {_q(s)})" for s in subs) + f" THEN '{g}'"
                      for g, subs in C.ANSWER_GROUPS)
    na_p, na_g = norm_answer_sql("prediction"), norm_answer_sql("answer")
    tp, tg = answer_tokens_sql("prediction"), answer_tokens_sql("answer")
    f1 = (f"CASE WHEN len(list_distinct({tp})) = 0 AND len(list_distinct({tg})) = 0 THEN 1.0 "
          f"WHEN len(list_distinct({tp})) = 0 OR len(list_distinct({tg})) = 0 THEN 0.0 "
          f"WHEN len(list_intersect(list_distinct({tp}), list_distinct({tg}))) = 0 THEN 0.0 "
          f"ELSE 2.0 * (len(list_intersect(list_distinct({tp}), list_distinct({tg}))) / len(list_distinct({tp}))) * "
          f"(len(list_intersect(list_distinct({tp}), list_distinct({tg}))) / len(list_distinct({tg}))) / "
          f"((len(list_intersect(list_distinct({tp}), list_distinct({tg}))) / len(list_distinct({tp}))) + "
          f"(len(list_intersect(list_distinct({tp}), list_distinct({tg}))) / len(list_distinct({tg})))) END")
    return f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
{eval_items_sql()},
{contexts_sql('items', 'regex')},
{candidates_sql('ctx', 'qid, doc_id', 'category')},
hints AS (SELECT qid, CASE {groups} END AS hint FROM (SELECT qid, {canonicalize_sql('lower(answer)')} AS gc FROM items)),
cands_h AS (SELECT c.*, h.hint FROM cands c JOIN hints h USING (qid)),
{select_sql('cands_h', hint='hint')},
sel AS (SELECT qid, phrase AS sel FROM pick WHERE rn = 1),
{_first_hit_sql().replace('SELECT qid, arg_min(phrase, ctx_rank) AS phrase, min(ctx_rank) AS hit_rank FROM ph GROUP BY qid',
                          '').rstrip()},
fh AS (SELECT qid, arg_min(phrase, ctx_rank) AS fh FROM ph GROUP BY qid),
cx AS (SELECT c.qid, i.answer, c.ctx_rank, c.doc_id,
  contains({norm_answer_sql('c.text')}, {norm_answer_sql('i.answer')}) AS hit,
  len({answer_tokens_sql('c.text')}) AS ntok FROM ctx c JOIN items i USING (qid)),
cxa AS (SELECT qid, count(*) AS n_ctx, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS n_hit,
  min(CASE WHEN hit THEN ctx_rank + 1 END) AS first_pos, avg(ntok) AS avg_tok, list(doc_id) AS ctx_docs FROM cx GROUP BY qid),
base AS (SELECT i.*, coalesce(nullif(sel.sel, ''), nullif(fh.fh, ''), '') AS prediction, cxa.* EXCLUDE (qid)
  FROM items i LEFT JOIN sel USING (qid) LEFT JOIN fh USING (qid) LEFT JOIN cxa USING (qid)),
m AS (SELECT qid AS item_id, category, prediction,
  CAST(coalesce(list_contains(ctx_docs, chunk_id), false) AS INTEGER) AS recall_at_5,
  CAST({na_p} = {na_g} AS INTEGER) AS exact_match,
  CASE WHEN {na_p} = '' OR {na_g} = '' THEN 0 ELSE CAST(contains({na_g}, {na_p}) OR contains({na_p}, {na_g}) AS INTEGER) END AS contains_match,
  round({f1}, 6) AS token_f1,
  CAST(lower(answer) = lower(prediction) AS INTEGER) AS em_raw,
  CAST({canonicalize_sql('lower(answer)')} = {canonicalize_sql('lower(prediction)')} AS INTEGER) AS em_canonical,
  CAST(contains(lower(prediction), answer) AS INTEGER) AS em_contains,
  CAST(len({tp}) AS INTEGER) AS answer_len_tokens,
  CASE WHEN {na_g} = '' THEN 0 ELSE CAST(coalesce(n_hit, 0) > 0 AS INTEGER) END AS retrieval_hit,
  round(CASE WHEN {na_g} = '' OR coalesce(n_ctx, 0) = 0 THEN 0.0 ELSE n_hit / greatest(n_ctx, 1) END, 6) AS context_hit_rate,
  CASE WHEN {na_g} <> '' THEN CAST(first_pos AS INTEGER) END AS first_hit_rank,
  round(CASE WHEN {na_g} <> '' AND first_pos IS NOT NULL THEN 1.0 / first_pos ELSE 0.0 END, 6) AS reciprocal_rank,
  CASE WHEN {na_g} <> '' AND first_pos <= 1 THEN 1 ELSE 0 END AS hit_at_1,
  CASE WHEN {na_g} <> '' AND first_pos <= 3 THEN 1 ELSE 0 END AS hit_at_3,
  CASE WHEN {na_g} <> '' AND first_pos <= 5 THEN 1 ELSE 0 END AS hit_at_5,
  round(CASE WHEN coalesce(n_ctx, 0) = 0 THEN 0.0 ELSE avg_tok END, 6) AS avg_context_len_tokens
FROM base)"""


ITEMS_SQL = _items_sql()


@register("metrics_items", f"""{ITEMS_SQL}
SELECT * FROM m""")
def metrics_items(spark, sf):
    """MET-1..8 + SEL-6/7 composition: per eval item prediction (hinted select, else first-hit
    phrase) and its answer / retrieval metrics."""
    m = _pred_items(spark, sf)
    return m.select(*[F.round(c, 6).alias(c) if c in ROUND6 else F.col(c) for c in ITEM_COLS])


@register("metrics_summary", f"""{ITEMS_SQL}
SELECT count(*) AS n_success, round(coalesce(avg(exact_match), 0), 6) AS exact_match,
  round(coalesce(avg(contains_match), 0), 6) AS contains_match, round(coalesce(avg(token_f1), 0), 6) AS token_f1,
  round(coalesce(avg(retrieval_hit), 0), 6) AS retrieval_hit, round(coalesce(avg(context_hit_rate), 0), 6) AS context_hit_rate,
  round(coalesce(avg(reciprocal_rank), 0), 6) AS mrr, round(coalesce(avg(hit_at_1), 0), 6) AS hit_at_1,
  round(coalesce(avg(hit_at_3), 0), 6) AS hit_at_3, round(coalesce(avg(hit_at_5), 0), 6) AS hit_at_5,
  round(coalesce(avg(answer_len_tokens), 0), 6) AS answer_len_tokens_mean,
  round(coalesce(avg(avg_context_len_tokens), 0), 6) AS avg_context_len_tokens_mean FROM m""")
def metrics_summary(spark, sf):
    """AGG-5: quality summary over all (successful) eval items."""
    s = M.quality_summary(_pred_items(spark, sf))
    return s.select("n_success", *[F.round(c, 6).alias(c) for c in s.columns if c != "n_success"])


@register("metrics_by_category", f"""{ITEMS_SQL}
SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS bucket, count(*) AS n, round(avg(recall_at_5), 6) AS recall_at_5,
  round(avg(em_raw), 6) AS em, round(avg(em_canonical), 6) AS em_canonical FROM m GROUP BY ROLLUP (category)""")
def metrics_by_category(spark, sf):
    """AGG-6: overall and per-category recall@5, EM, canonical EM."""
    b = M.by_category(_pred_items(spark, sf))
    return b.select("bucket", "n", *[F.round(c, 6).alias(c) for c in ["recall_at_5", "em", "em_canonical"]])


#: A twelfth of the evaluation requests counts as failed, some of them without any status.
STATUS_SQL = "CASE substr(md5(item_id), 1, 1) WHEN '0' THEN 503 WHEN '1' THEN NULL ELSE 200 + length(item_id) % 5 END"


@register("metrics_success_only", f"""{ITEMS_SQL},
st AS (SELECT *, {STATUS_SQL} AS code FROM m),
ok AS (SELECT *, coalesce(code BETWEEN 200 AND 299, false) AS ok FROM st)
SELECT part, count(*) AS n_success, round(coalesce(avg(exact_match), 0), 6) AS exact_match, round(coalesce(avg(token_f1), 0), 6) AS token_f1,
  round(coalesce(avg(reciprocal_rank), 0), 6) AS mrr, round(coalesce(avg(hit_at_5), 0), 6) AS hit_at_5
FROM (SELECT 'all' AS part, * FROM ok UNION ALL SELECT 'success_only', * FROM ok WHERE ok) GROUP BY part""")
def metrics_success_only(spark, sf):
    """FLT-7 + AGG-5: the quality summary over all evaluation requests and over those that succeeded by
    their status code."""
    code = F.expr("case substr(md5(item_id), 1, 1) when '0' then 503 when '1' then null else 200 + length(item_id) % 5 end")
    m = _pred_items(spark, sf).withColumn("code", code)
    m = m.withColumn("part", F.explode(F.when(M.status_ok("code"), F.array(F.lit("all"), F.lit("success_only"))).otherwise(F.array(F.lit("all")))))
    s = M.quality_summary(m, by=["part"])
    return s.select("part", "n_success", *[F.round(c, 6).alias(c) for c in ("exact_match", "token_f1", "mrr", "hit_at_5")])
