"""Registered extraction queries over the derived filings view (cue sentences appended)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators import extract as EX
from annualis.operators import rank as R
from annualis.plans.pipeline import (CONTEXTS_SQL, category_match_sql, preferred_filings, question_candidates,
                                     question_contexts, substring_match_sql)
from annualis.plans.q_text import SENT_SQL
from annualis.plans.registry import register
from annualis.sources.filings import lookup_corpus
from annualis.sources.tables import FILINGS_V_SQL, Q_V_SQL, filings, questions

TOK_SQL = r"'[\p{L}\p{N}_]+|\S'"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_candidate_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    return f"lower(regexp_replace({s}, '^[ ,.;:\\-]+|[ ,.;:\\-]+$', '', 'g'))"


def tok_index_sql(s: str, p: str) -> str:
    ch = f"substring({s}, ({p}) + 1, 1)"
    return (f"CASE WHEN {ch} = '' OR regexp_matches({ch}, '^\\s$') "
            f"THEN greatest(len(regexp_extract_all({s}, {TOK_SQL}, 0)) - 1, 0) "
            f"ELSE len(regexp_extract_all(substring({s}, 1, ({p}) + 1), {TOK_SQL}, 0)) - 1 END")


def anchor_positions_sql(s: str, rx: str) -> str:
    r = _q("(?i)" + rx)
    ms = f"regexp_extract_all({s}, {r}, 0)"
    ps = f"regexp_split_to_array({s}, {r})"
    start = (f"CAST(coalesce(list_sum(list_transform(({ps})[1:j], lambda x: length(x))), 0) + "
             f"coalesce(list_sum(list_transform(({ms})[1:j - 1], lambda x: length(x))), 0) AS BIGINT)")
    return f"list_transform(range(1, len({ms}) + 1), lambda j: len(regexp_extract_all(substring({s}, 1, {start}), {TOK_SQL}, 0)))"


def anchor_ok_sql(s: str, cat: str) -> str:
    whens = " ".join(
        f"WHEN {cat} = '{k}' THEN len(list_filter({anchor_positions_sql(s, rx)}, "
        f"lambda a: abs(a - d_start) <= {w} OR abs(a - d_end) <= {w})) > 0"
        for k, (rx, w) in C.ANCHORS.items())
    return f"CASE {whens} ELSE true END"


def tags_sql(x: str, groups: dict) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({x}, {_q('(?i)' + rx)}) THEN '{n}' END" for n, rx in groups.items())
    return f"list_filter([{items}], lambda g: g IS NOT NULL)"


def candidates_sql(ctx: str, keys: str, cat: str) -> str:
    """CTEs from a contexts CTE (``keys`` columns, ``ctx_rank``, ``text``) to ``cands``."""
    unions = "\n    UNION ALL ".join(
        f"SELECT *, {i} AS patt_pos, regexp_extract(sentence, {_q(EX.cue_regex(cue))}, 1) AS pre, "
        f"regexp_extract(sentence, {_q(EX.cue_regex(cue))}, 2) AS cue, "
        f"regexp_extract(sentence, {_q(EX.cue_regex(cue))}, 3) AS raw FROM sents"
        for i, cue in enumerate(C.CANDIDATE_CUES))
    return f"""s0 AS (SELECT {keys}, {cat} AS category, ctx_rank, {SENT_SQL} AS ss FROM {ctx}),
sents AS (SELECT {keys}, category, ctx_rank, CAST(i - 1 AS INTEGER) AS sent_pos, ss[i] AS sentence
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM s0)),
m0 AS (SELECT * FROM ({unions}) WHERE cue <> ''),
m1 AS (SELECT *, {tok_index_sql('sentence', 'length(pre) + length(cue)')} AS d_start,
  {tok_index_sql('sentence', 'length(pre) + length(cue) + length(raw) - 1')} AS d_end FROM m0),
cands AS (SELECT {keys}, category, ctx_rank, sent_pos, CAST(patt_pos AS INTEGER) AS patt_pos,
  {clean_candidate_sql('raw')} AS phrase, sentence, 0.0 AS ce_score,
  {tags_sql('pre', C.SUBJECT_GROUPS)} AS subj_groups, {tags_sql(clean_candidate_sql('raw'), C.CANDIDATE_GROUPS)} AS cand_groups
  FROM m1 WHERE {anchor_ok_sql('sentence', 'category')})"""


# ------------------------------------------------------------------------------ queries

@register("cue_filter", f"""WITH {FILINGS_V_SQL},
cats(category) AS (VALUES {', '.join(f"('{k}')" for k in C.QUESTIONS)})
SELECT f.doc_id, c.category FROM filings_v f CROSS JOIN cats c WHERE {category_match_sql('f.text', 'c.category')}""")
def cue_filter(spark, sf):
    """FLT-4: filings that match each category's anchor regex and a driver cue."""
    fil = filings(spark, sf)
    cats = F.array(*[F.lit(k) for k in C.QUESTIONS])
    x = fil.select("doc_id", "text", F.explode(cats).alias("category"))
    return x.filter(EX.category_match(F.col("text"), F.col("category"))).select("doc_id", "category")


@register("cue_filter_substring", f"""WITH {FILINGS_V_SQL},
cats(category) AS (VALUES {', '.join(f"('{k}')" for k in C.QUESTIONS)}, ('other'))
SELECT f.doc_id, c.category FROM filings_v f CROSS JOIN cats c WHERE {substring_match_sql('f.text', 'c.category')}""")
def cue_filter_substring(spark, sf):
    """FLT-5: the training script's substring predicate (unknown category passes)."""
    fil = filings(spark, sf)
    cats = F.array(*[F.lit(k) for k in list(C.QUESTIONS) + ["other"]])
    x = fil.select("doc_id", "text", F.explode(cats).alias("category"))
    return x.filter(EX.category_match_substring(F.col("text"), F.col("category"))).select("doc_id", "category")


KW_SQL = " + ".join(f"CAST(contains(lower(text), {_q(k)}) AS INTEGER)" for k in C.keywords_array())


@register("keyword_score", f"""WITH {FILINGS_V_SQL},
s AS (SELECT doc_id, company, year, {KW_SQL} AS kw_score FROM filings_v),
r AS (SELECT *, row_number() OVER (PARTITION BY company, year ORDER BY kw_score DESC, doc_id) AS rn FROM s)
SELECT company, year, doc_id, kw_score, CAST(rn AS INTEGER) AS kw_rank FROM r WHERE rn <= 8""")
def keyword_score(spark, sf):
    """JN-11 + WIN-11: distinct segment keywords per filing, best 8 per (company, year)."""
    fil = filings(spark, sf)
    s = fil.select("doc_id", "company", "year", EX.keyword_score(F.col("text")).alias("kw_score"))
    return R.cap_per_group(s, ["company", "year"], [F.col("kw_score").desc(), F.col("doc_id")], 8, "kw_rank")


def _driver_patterns_sql(text: str):
    out = []
    for p in C.DRIVER_REGEX:
        rx = _q("(?i)" + p)
        ph = f"regexp_replace(regexp_replace(regexp_extract({text}, {rx}, 1), '^\\s+|\\s+$', '', 'g'), '[\\s·•]+$', '', 'g')"
        out.append((f"regexp_matches({text}, {rx})", ph))
    return out


def _driver_answer_sql(text: str) -> str:
    whens = " ".join(f"WHEN {m} AND {ph} <> '' THEN {ph}" for m, ph in _driver_patterns_sql(text))
    return f"CASE {whens} END"


@register("driver_lookup", f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
lk AS (SELECT qid, lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) AS co, year AS qyr FROM q_v WHERE category = 'revenue_driver'),
corp AS (SELECT doc_id, lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) AS co, year AS yr,
  regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM filings_v),
ctx AS (SELECT lk.qid, corp.doc_id, corp.text, {KW_SQL.replace('lower(text)', 'lower(corp.text)')} AS score
  FROM corp JOIN lk ON lk.co = corp.co WHERE lk.qyr IS NULL OR corp.yr = lk.qyr),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn FROM ctx) WHERE rn <= 8),
pc AS (SELECT *, {_driver_answer_sql('text')} AS ans FROM rk),
agg AS (SELECT qid, arg_min(ans, rn) FILTER (WHERE ans IS NOT NULL) AS hit_ans,
  arg_min(doc_id, rn) FILTER (WHERE ans IS NOT NULL) AS hit_doc, arg_min(text, rn) AS best_text, arg_min(doc_id, rn) AS best_doc
  FROM pc GROUP BY qid)
SELECT lk.qid, coalesce(hit_ans, CASE WHEN length(best_text) > 280 THEN substring(best_text, 1, 280) || '…' ELSE best_text END, '') AS answer,
  coalesce(hit_doc, best_doc) AS context_doc, CAST(hit_ans IS NOT NULL AS INTEGER) AS matched
FROM lk LEFT JOIN agg ON agg.qid = lk.qid""")
def driver_lookup(spark, sf):
    """EXT-2 + FLT-2: revenue driver per company (and year) from its filings."""
    fil = filings(spark, sf)
    lk = questions(spark, fil).filter(F.col("category") == "revenue_driver").select("qid", "company", "year")
    return EX.driver_lookup(lk, fil)


@register("driver_lookup_meta", f"""WITH {FILINGS_V_SQL},
{Q_V_SQL},
lk AS (SELECT qid, lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) AS co, year AS qyr FROM q_v WHERE category = 'revenue_driver'),
meta AS (SELECT doc_id, text, company AS m_company, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE year END AS m_year FROM filings_v),
corp AS (SELECT doc_id, lower(regexp_replace(m_company, '^\\s+|\\s+$', '', 'g')) AS co, m_year AS yr,
  regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM meta),
ctx AS (SELECT lk.qid, corp.doc_id, corp.text, {KW_SQL.replace('lower(text)', 'lower(corp.text)')} AS score
  FROM corp JOIN lk ON lk.co = corp.co WHERE lk.qyr IS NULL OR corp.yr = lk.qyr),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rn FROM ctx) WHERE rn <= 8),
pc AS (SELECT *, {_driver_answer_sql('text')} AS ans FROM rk),
agg AS (SELECT qid, arg_min(ans, rn) FILTER (WHERE ans IS NOT NULL) AS hit_ans,
  arg_min(doc_id, rn) FILTER (WHERE ans IS NOT NULL) AS hit_doc, arg_min(text, rn) AS best_text, arg_min(doc_id, rn) AS best_doc
  FROM pc GROUP BY qid)
SELECT lk.qid, coalesce(hit_ans, CASE WHEN length(best_text) > 280 THEN substring(best_text, 1, 280) || '…' ELSE best_text END, '') AS answer,
  coalesce(hit_doc, best_doc) AS context_doc, CAST(hit_ans IS NOT NULL AS INTEGER) AS matched
FROM lk LEFT JOIN agg ON agg.qid = lk.qid""")
def driver_lookup_meta(spark, sf):
    """EXT-2 + FLT-2 on a corpus of (text, meta) rows whose company stands under company, Company or ticker
    and whose year is sometimes no integer."""
    m = F.col("doc_id") % 3
    pairs = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v)])
    year = F.when(F.col("doc_id") % 7 == 3, F.concat(F.col("year").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), F.col("year").cast("string")))
    meta = F.when(m == 0, pairs(("company", F.col("company")), ("ticker", F.lit("none")), ("year", year))) \
        .when(m == 1, pairs(("company", F.lit("")), ("Company", F.col("company")), ("Year", year))) \
        .otherwise(pairs(("ticker", F.col("company")), ("year", F.lit("")), ("Year", year)))
    fil = filings(spark, sf)
    lk = questions(spark, fil).filter(F.col("category") == "revenue_driver").select("qid", "company", "year")
    return EX.driver_lookup(lk, lookup_corpus(fil.select("doc_id", "text", meta.alias("meta"))))


@register("prefer_company", f"""{CONTEXTS_SQL}
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) - 1 AS INTEGER) AS pref_rank FROM pall""")
def prefer_company(spark, sf):
    """WIN-7: all filings of the question's company when it has any, else of its category, by BM25."""
    return preferred_filings(spark, sf)


@register("category_priority", f"""{CONTEXTS_SQL}
SELECT qid, doc_id, ctx_rank, is_cat FROM ctx""")
def category_priority(spark, sf):
    """WIN-6: category-matching contexts first, each once, top 5."""
    ctx = question_contexts(spark, sf)
    return ctx.select("qid", "doc_id", "ctx_rank",
                      EX.category_match(F.col("text"), F.col("category")).alias("is_cat"))


def _normalize_extract_sql(x: str) -> str:
    s = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    s = f"regexp_replace({s}, '[\\s,;:.]+$', '', 'g')"
    return f"regexp_replace({s}, '\\s+', ' ', 'g')"


def _first_hit_sql() -> str:
    whens = " ".join(
        f"WHEN regexp_matches(text, {_q('(?i)' + p)}) THEN {_normalize_extract_sql('regexp_extract(text, ' + _q('(?i)' + p) + ', 1)')}"
        for p in C.DRIVER_REGEX)
    anyhit = " OR ".join(f"regexp_matches(text, {_q('(?i)' + p)})" for p in C.DRIVER_REGEX)
    return f"""ph AS (SELECT qid, ctx_rank, CASE {whens} END AS phrase FROM ctx WHERE coalesce(text, '') <> '' AND ({anyhit}))
SELECT qid, arg_min(phrase, ctx_rank) AS phrase, min(ctx_rank) AS hit_rank FROM ph GROUP BY qid"""


@register("first_hit_phrase", f"""{CONTEXTS_SQL},
{_first_hit_sql()}""")
def first_hit_phrase(spark, sf):
    """EXT-1: first configured pattern hit over each question's 5 ranked contexts."""
    return EX.first_hit_phrase(question_contexts(spark, sf))


CANDS_SQL = f"""{CONTEXTS_SQL},
{candidates_sql('ctx', 'qid, doc_id', 'category')}"""


def _cands(spark, sf):
    return question_candidates(spark, sf)


@register("candidates", f"""{CANDS_SQL}
SELECT qid, doc_id, ctx_rank, sent_pos, patt_pos, phrase, array_to_string(subj_groups, ',') AS subj,
  array_to_string(cand_groups, ',') AS cand FROM cands""")
def candidates(spark, sf):
    """EXT-3 + EXT-4 + JN-10: candidates of each question's 5 contexts with its category's anchor rule."""
    c = _cands(spark, sf)
    return c.select("qid", "doc_id", "ctx_rank", "sent_pos", "patt_pos", "phrase",
                    F.array_join("subj_groups", ",").alias("subj"), F.array_join("cand_groups", ",").alias("cand"))


@register("group_tags", f"""WITH {FILINGS_V_SQL},
ctxall AS (SELECT doc_id, 0 AS ctx_rank, text FROM filings_v),
{candidates_sql('ctxall', 'doc_id', 'CAST(NULL AS VARCHAR)')}
SELECT doc_id, sent_pos, patt_pos, phrase, array_to_string(subj_groups, ',') AS subj,
  array_to_string(cand_groups, ',') AS cand FROM cands""")
def group_tags(spark, sf):
    """JN-10 over every filing: all cue candidates (no category) with subject / candidate groups."""
    fil = filings(spark, sf).select("doc_id", "text", F.lit(0).alias("ctx_rank"), F.lit(None).cast("string").alias("category"))
    c = EX.extract_candidates(fil, q_key="doc_id")
    return c.select("doc_id", "sent_pos", "patt_pos", "phrase", F.array_join("subj_groups", ",").alias("subj"),
                    F.array_join("cand_groups", ",").alias("cand"))


def canonicalize_sql(x: str) -> str:
    s = f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"
    s = f"regexp_replace(regexp_replace({s}, '\\s+', ' ', 'g'), '^[ ,.;:\\-]+|[ ,.;:\\-]+$', '', 'g')"
    for pat, repl in C.CANON_SUBSTITUTIONS:
        if pat.startswith("(?<!xbox )"):
            # RE2 has no look-behind: protect existing "xbox game pass", rewrite, restore
            s = f"replace(regexp_replace(regexp_replace({s}, '(?i)xbox game pass\\b', chr(1), 'g'), '(?i)game pass\\b', 'xbox game pass', 'g'), chr(1), 'xbox game pass')"
        else:
            s = f"regexp_replace({s}, {_q('(?i)' + pat)}, {_q(repl)}, 'g')"
    for pat in C.CANON_PREFIXES:
        s = f"regexp_replace({s}, {_q('(?i)' + pat)}, '', 'g')"
    # RE2 has no back-references: drop a word equal to the previous one (list form)
    w = f"string_split({s}, ' ')"
    return (f"array_to_string(list_filter({w}, lambda x, i: NOT (i > 1 AND regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]+') "
            f"AND x = ({w})[i - 1] AND (i = 2 OR ({w})[i - 2] <> x))), ' ')")


@register("canonicalize", f"""WITH {FILINGS_V_SQL},
ctxall AS (SELECT doc_id, 0 AS ctx_rank, text FROM filings_v),
{candidates_sql('ctxall', 'doc_id', 'CAST(NULL AS VARCHAR)')},
ph AS (SELECT DISTINCT phrase FROM cands)
SELECT phrase, {canonicalize_sql('phrase')} AS canonical FROM ph""")
def canonicalize(spark, sf):
    """TXT-14 + TXT-15: canonical form of every distinct candidate phrase of the filings."""
    fil = filings(spark, sf).select("doc_id", "text", F.lit(0).alias("ctx_rank"), F.lit(None).cast("string").alias("category"))
    ph = EX.extract_candidates(fil, q_key="doc_id").select("phrase").distinct()
    return ph.select("phrase", TX.canonicalize(F.col("phrase")).alias("canonical"))


@register("grep_chunks", f"""WITH {FILINGS_V_SQL},
m AS (SELECT doc_id, company, year, text FROM filings_v WHERE regexp_matches(text, '(?i)driven by azure'))
SELECT doc_id, company, year, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 300) AS snippet,
  (SELECT count(*) FROM m) AS total_hits FROM m ORDER BY doc_id LIMIT 5""")
def grep_chunks(spark, sf):
    """FLT-6: regex search over every filing: the first 5 hits in corpus order with their
    metadata and a 300-char snippet, plus the total number of hits (the limit is the feature)."""
    m = filings(spark, sf).filter(F.col("text").rlike("(?i)driven by azure"))
    total = m.select(F.count(F.lit(1))).scalar()
    first = m.orderBy("doc_id").limit(5)
    return first.select("doc_id", "company", "year", F.substring(TX.strip_ws(F.col("text")), 1, 300).alias("snippet"),
                        total.alias("total_hits"))
