"""Registered context queries over each question's retrieved pool: pair-score rerank,
token-budget packing and the prompt table."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators import generation as G
from annualis.operators import rank as R
from annualis.plans.pipeline import CONTEXTS_SQL, question_contexts
from annualis.plans.q_extract import _q
from annualis.plans.q_text import TOKEN_SQL, detok_sql, token_f1_sql
from annualis.plans.registry import register


@register("rerank_overlap", f"""{CONTEXTS_SQL},
sc AS (SELECT qid, doc_id, pref_rank, round({token_f1_sql('text', 'q.question')}, 6) AS ce_score
  FROM pref JOIN (SELECT qid AS qq, question FROM q_v) q ON q.qq = pref.qid),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ce_score DESC, pref_rank) AS rn FROM sc)
SELECT qid, doc_id, CAST(rn AS INTEGER) AS rr_rank, ce_score FROM rr WHERE rn <= 5""")
def rerank_overlap(spark, sf):
    """WIN-1 / WIN-2: rerank each question's pool by a pair scorer (token-set F1 of question
    and passage; the reference's no-model fallback is the identity scorer), stable, top 5."""
    pref = question_contexts(spark, sf, stage="prefer")
    scored = pref.withColumn("_s", F.round(TX.token_f1(F.col("text"), F.col("question")), 6))
    out = R.rerank(scored, F.col("_s"), q_key="qid", in_rank="ctx_rank", top_k=5)
    return out.select("qid", "doc_id", F.col("rr_rank").cast("int").alias("rr_rank"), "ce_score")


PROMPT_SQL = _q(C.PROMPT_TEMPLATE).replace("{ctx}", "' || context || '").replace("{q}", "' || question || '")


PROMPTS_SQL = f"""{CONTEXTS_SQL},
tk AS (SELECT qid, question, ctx_rank, regexp_extract_all(lower(coalesce(text, '')), {TOKEN_SQL}, 0) AS toks FROM ctx
  JOIN (SELECT qid AS qq, question FROM q_v) q ON q.qq = ctx.qid),
pv AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY qid ORDER BY ctx_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM tk),
pk AS (SELECT qid, question, ctx_rank, list_slice(toks, 1, CAST(greatest(0, 480 - prev) AS BIGINT)) AS take FROM pv WHERE prev < 480),
agg AS (SELECT qid, question, count(*) AS n_parts, CAST(sum(len(take)) AS BIGINT) AS context_tokens,
  string_agg({detok_sql('take')}, chr(10) || chr(10) ORDER BY ctx_rank) AS context FROM pk GROUP BY qid, question)"""


@register("prompt_table", f"""{PROMPTS_SQL}
SELECT qid, n_parts, context_tokens, md5({PROMPT_SQL}) AS prompt_md5 FROM agg""")
def prompt_table(spark, sf):
    """WIN-5 + TXT-20: each question's 5 contexts packed into 480 tokens (last one cut),
    then the generation prompt (template + context + question)."""
    p = prompts(spark, sf)
    return p.select("qid", "n_parts", "context_tokens", F.md5("prompt").alias("prompt_md5"))


def prompts(spark, sf):
    """(qid, n_parts, context_tokens, prompt) of every question."""
    ctx = question_contexts(spark, sf).withColumn("toks", TX.word_pieces("text"))
    packed = R.pack_tokens(ctx, "toks", q_key="qid", rank_col="ctx_rank")
    agg = packed.groupBy("qid", "question").agg(  # at most 5 parts per question
        F.count(F.lit(1)).alias("n_parts"), F.sum(F.size("take")).cast("long").alias("context_tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ctx_rank", TX.detokenize("take").alias("t")))),
                                 lambda x: x["t"]), "\n\n").alias("context"))
    return agg.select("qid", "n_parts", "context_tokens", G.build_prompt("context", "question").alias("prompt"))


@register("generated_answers", f"""{PROMPTS_SQL},
w AS (SELECT qid, list_slice(list_filter(string_split_regex(context, '\\s+'), lambda x: x <> ''), 1, 8) AS words FROM agg)
SELECT qid, CASE WHEN len(words) = 0 THEN 'not found in context' ELSE array_to_string(words, ' ') END AS answer FROM w""")
def generated_answers(spark, sf):
    """TXT-20 + 2.12: the prompt table through the batched generator (default: the first words of the
    context) and the text after the answer mark."""
    return G.answers(prompts(spark, sf), "prompt").select("qid", "answer")
