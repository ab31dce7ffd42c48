"""The question -> contexts composition used by the extraction and selection queries
(SURVEY 3.3): score all filings per category question (BM25), prefer the question's
company, put category-matching contexts first, keep 5.

Spark and DuckDB versions are written side by side so the oracle follows the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annualis import config as C
from annualis.operators import extract as EX
from annualis.operators import lexical as LX
from annualis.operators.prefix import prefix_sums
from annualis.plans.q_retrieval import bm25_sql
from annualis.session import bounded_broadcast, cut_lineage
from annualis.sources.tables import FILINGS_V_SQL, Q_V_SQL, filings, questions

TOP_CONTEXTS = 5
#: Filings a question is given before the rerank, at most.
RERANK_K = 400


def scored_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Every filing that shares a term with a category question, with its company and both category
    predicates, without texts: (category, doc_id, score rounded to 1e-6, doc_company, _cat_regex,
    _cat_sub).  Narrow rows, checkpointed: a query reads them several times."""
    fil = filings(spark, sf)
    scores = LX.bm25_topk(fil, C.questions_df(spark), k=None, doc_key="doc_id", q_key="category", q_text="question")
    t, low = F.col("text"), F.col("_low")
    flags = fil.withColumn("_low", F.lower("text")).select("doc_id", F.col("company").alias("doc_company"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("category"), EX.category_match(t, F.lit(k), low).alias("_cat_regex"),
                 EX.category_match_substring(t, F.lit(k), low).alias("_cat_sub")) for k in C.QUESTIONS])))
    scores = scores.select("category", "doc_id", F.round("score", 6).alias("score"))
    return cut_lineage(scores.join(flags, ["category", "doc_id"], "inner"))


def question_contexts(spark: SparkSession, sf: str, stage: str = "top", qv: DataFrame | None = None,
                      priority: str = "regex", with_text: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """(qid, category, company, year, doc_id, ctx_rank 0-based, text) per question.

    ``qv`` defaults to the q_v question table; ``priority`` is the category predicate used
    to put contexts first: ``regex`` (FLT-4, evaluation) or ``substring`` (FLT-5, training).
    Stage ``prefer`` stops before that and gives the first ``RERANK_K`` by score.
    A question sees its company's filings, or all of its category if the company has none
    (WIN-7).  The first ones are therefore found once per (category, company) and once per
    category, straight from the scores (``row_number() <= k``, limited before the shuffle), and meet
    the questions by key; texts are joined back at the end."""
    fil = filings(spark, sf)
    qv = questions(spark, fil) if qv is None else qv
    scored = scored_filings(spark, sf) if scored is None else scored
    order = [F.col("score").desc(), F.col("doc_id")]
    if stage != "prefer":
        order.insert(0, F.col("_cat_regex" if priority == "regex" else "_cat_sub").desc())
    most = RERANK_K if stage == "prefer" else TOP_CONTEXTS

    def first(keys: list[str], df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
        return top.select("category", "doc_id", "doc_company", (F.col("_n") - 1).cast("int").alias("ctx_rank"))

    own = first(["category", "doc_company"], scored.where("doc_company is not null"))
    rest = F.broadcast(first(["category"], scored))  # bounded: ``most`` rows a category
    known = scored.select("category", F.col("doc_company").alias("company")).distinct()
    out = (qv.join(own.withColumn("company", F.col("doc_company")), ["category", "company"], "inner")
           .unionByName(qv.join(known, ["category", "company"], "left_anti").join(rest, "category", "inner")))
    return with_texts(spark, sf, out) if with_text else out


def with_texts(spark: SparkSession, sf: str, keys: DataFrame) -> DataFrame:
    """``keys`` with the texts of their filings: the few keys travel, the filings do not."""
    return filings(spark, sf).select("doc_id", "text").join(bounded_broadcast(cut_lineage(keys)), "doc_id", "inner")


def preferred_filings(spark: SparkSession, sf: str, qv: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, pref_rank 0-based): every filing a question may see (WIN-7), its company's or, if
    the company has none, all of its category, in the order of the score.

    Filings are numbered once per (category, company), and once per category if some question needs
    that, by running sums over range partitions, so no task holds a company; the questions travel to
    them."""
    fil = filings(spark, sf)
    qv = cut_lineage((questions(spark, fil) if qv is None else qv).select("qid", "category", "company"))
    scored = scored_filings(spark, sf).select("category", F.col("doc_company").alias("company"), "doc_id", "score")

    def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
        run = prefix_sums(rows.withColumn("_one", F.lit(1)), [*keys, F.col("score").desc(), "doc_id"], {"_at": "_one"})
        first = cut_lineage(run.groupBy(*keys).agg(F.min("_at").alias("_first")))
        run = run.join(bounded_broadcast(first), keys).select(*keys, "doc_id", (F.col("_at") - F.col("_first")).cast("int").alias("pref_rank"))
        return run.join(fil.select("doc_id"), "doc_id", "inner")

    def seen(rows: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(bounded_broadcast(by), keys, "inner").select("qid", "doc_id", "pref_rank")

    out = seen(placed(scored.where("company is not null"), ["category", "company"]), qv, ["category", "company"])
    lost = cut_lineage(qv.join(scored.select("category", "company").distinct(), ["category", "company"], "left_anti"))
    if lost.isEmpty():
        return out
    return out.unionByName(seen(placed(scored.select("category", "doc_id", "score"), ["category"]), lost.drop("company"), ["category"]))


def question_candidates(spark: SparkSession, sf: str, qv: DataFrame | None = None, priority: str = "regex",
                        keep: list[str] | None = None, scored: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Candidates (EXT-4) of every question's contexts.  Extraction depends only on the
    context text and the category, so it runs once per (category, document) that is a
    context and the question keys are joined to it.  ``keys`` are contexts found already."""
    if keys is None:
        keys = cut_lineage(question_contexts(spark, sf, qv=qv, priority=priority, with_text=False, scored=scored))
    keys = keys.select("qid", "category", "doc_id", "ctx_rank", *(keep or []))
    used = with_texts(spark, sf, keys.select("category", "doc_id").distinct())
    c = EX.extract_candidates(used.select("category", "doc_id", "text", F.lit(0).alias("_r")),
                              q_key="doc_id", rank_col="_r").drop("ctx_rank")
    return keys.join(c, ["category", "doc_id"], "inner")


def _sql_regex_bool(text: str, rx: str) -> str:
    return f"regexp_matches({text}, '(?i){rx}')"


def category_match_sql(text: str, cat: str) -> str:
    cue = _sql_regex_bool(text, C.CUE_ANY)
    whens = " ".join(f"WHEN {cat} = '{k}' THEN {_sql_regex_bool(text, rx)} AND {cue}" for k, rx in C.CATEGORY_REGEX.items())
    return f"coalesce(CASE {whens} ELSE false END, false)"


def substring_match_sql(text: str, cat: str) -> str:
    low = f"lower({text})"
    cue = " OR ".join(f"contains({low}, '{c}')" for c in C.TRAIN_CUES)
    whens = " ".join(
        f"WHEN {cat} = '{k}' THEN ({' OR '.join(f"contains({low}, '{w}')" for w in ws)}) AND ({cue})"
        for k, ws in C.TRAIN_CATEGORY_WORDS.items())
    return f"coalesce(CASE {whens} ELSE true END, true)"


def contexts_sql(qsrc: str = "q_v", priority: str = "regex") -> str:
    """CTE chain ending in ``ctx`` (and ``pref``); ``qsrc`` is a CTE with
    (qid, category, company, year); it must be defined by the caller unless it is q_v."""
    pred = category_match_sql if priority == "regex" else substring_match_sql
    return f"""{bm25_sql('filings_v', 'doc_id', 'text', 'cats', 'category', 'question', None, prefix='p')},
pool AS (SELECT qid AS category, doc_id, round(score, 6) AS score FROM p_sc),
cand AS (SELECT q.qid, q.category, q.company, q.year, p.doc_id, p.score, f.company AS doc_company, f.text
  FROM {qsrc} q JOIN pool p ON p.category = q.category JOIN filings_v f ON f.doc_id = p.doc_id),
pall AS (SELECT * FROM (SELECT *, max(CASE WHEN doc_company = company THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS anyc
  FROM cand) WHERE doc_company = company OR anyc = 0),
pref AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS pref_rank
  FROM pall) WHERE pref_rank < {RERANK_K}),
prio AS (SELECT *, {pred('text', 'category')} AS is_cat FROM pall),
ctx AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY is_cat DESC, score DESC, doc_id) - 1 AS INTEGER)
  AS ctx_rank FROM prio) WHERE ctx_rank < {TOP_CONTEXTS})"""


CONTEXTS_SQL = f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
{contexts_sql()}"""
