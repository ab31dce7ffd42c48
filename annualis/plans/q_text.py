"""Registered text queries: HTML cleaning, chunk windows and ids, normalisers, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis import config as C
from annualis.functions import text as TX
from annualis.operators import chunking as CH
from annualis.plans.registry import register
from annualis.sources.tables import table

TOKEN_SQL = r"'[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"


def _replace_chain(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    return expr


def html_text_sql(col: str) -> str:
    s = col
    for t in ["script", "style", "noscript"]:
        s = f"regexp_replace({s}, '(?is)<{t}\\b.*?</{t}\\s*>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<![^>]*>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]+>', ' ', 'g')"
    s = _replace_chain(s, TX.HTML_ENTITIES)
    s = f"regexp_replace({s}, '[\\s\\x{{00A0}}]+', ' ', 'g')"
    return f"regexp_replace({s}, '^ +| +$', '', 'g')"


@register("html_text", f"""SELECT page_id, {html_text_sql('html')} AS text,
  CAST(length({html_text_sql('html')}) AS INTEGER) AS text_chars FROM pages""")
def html_text(spark, sf):
    """TXT-1 + TXT-4: cleaned page text and its length (catalog text_chars)."""
    p = table(spark, sf, "pages", ["page_id", "html"])
    t = TX.html_to_text("html")
    return p.select("page_id", t.alias("text"), F.length(t).alias("text_chars"))


def detok_sql(expr: str) -> str:
    return _replace_chain(f"array_to_string({expr}, ' ')", TX.DECODE_CLEANUPS)


CHUNKS_SQL = f"""t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {TOKEN_SQL}, 0) AS toks FROM documents),
n AS (SELECT doc_id, toks, len(toks) AS n FROM t WHERE len(toks) > 0),
w AS (SELECT doc_id, toks, unnest(range(0, CASE WHEN n <= 256 THEN 0 ELSE CAST(ceil((n - 256) / 216.0) AS BIGINT) END + 1)) AS j FROM n),
chunks AS (SELECT doc_id, CAST(j AS INTEGER) AS chunk_no,
  CAST(len(list_slice(toks, j * 216 + 1, j * 216 + 256)) AS INTEGER) AS n_tokens,
  {detok_sql('list_slice(toks, j * 216 + 1, j * 216 + 256)')} AS text FROM w)"""


@register("chunk_windows", f"""WITH {CHUNKS_SQL}
SELECT doc_id, chunk_no, n_tokens, text FROM chunks""")
def chunk_windows(spark, sf):
    """TXT-5 + TXT-6: 256-token windows with 40 tokens of overlap, decoded text."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return CH.chunk_documents(docs)


@register("chunk_ids", f"""WITH {CHUNKS_SQL},
cnt AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
off AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cnt)
SELECT c.doc_id, c.chunk_no, CAST(off.o + c.chunk_no AS BIGINT) AS chunk_id FROM chunks c JOIN off USING (doc_id)""")
def chunk_ids(spark, sf):
    """TXT-7: global chunk ids in document order, distributed prefix sum."""
    docs = table(spark, sf, "documents", ["doc_id", "text"])
    return CH.chunk_ids(docs)


@register("catalog_chunk_ids", f"""WITH {CHUNKS_SQL},
cat AS (SELECT 'F-' || doc_id AS doc_key, doc_id, upper(source) AS company, md5(CAST(doc_id AS VARCHAR)) AS place FROM documents),
cnt AS (SELECT doc_key, company, place, count(c.doc_id) AS n FROM cat LEFT JOIN chunks c USING (doc_id) GROUP BY ALL),
off AS (SELECT doc_key, coalesce(sum(n) OVER (ORDER BY company NULLS FIRST, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM cnt)
SELECT doc_key, c.chunk_no, CAST(off.o + c.chunk_no AS BIGINT) AS chunk_id, md5(c.text) AS text_md5
FROM chunks c JOIN cat USING (doc_id) JOIN off USING (doc_key)""")
def catalog_chunk_ids(spark, sf):
    """TXT-5..7: windows with ids that run on in the order of a catalog that is sorted by company and
    a text key, for documents with text ids."""
    d = table(spark, sf, "documents", ["doc_id", "source", "text"])
    d = d.select(F.concat(F.lit("F-"), F.col("doc_id").cast("string")).alias("doc_key"), F.coalesce(F.upper("source"), F.lit("")).alias("company"),
                 F.md5(F.col("doc_id").cast("string")).alias("place"), "text")
    out = CH.chunk_and_number(d, id_col="doc_key", order=["company", "place"])
    return out.select("doc_key", "chunk_no", "chunk_id", F.md5("text").alias("text_md5"))


def norm_answer_sql(col: str) -> str:
    s = f"regexp_replace(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def answer_tokens_sql(col: str) -> str:
    return (f"list_filter(string_split({norm_answer_sql(col)}, ' '), "
            f"lambda t: t <> '' AND NOT list_contains({STOP_SQL}, t) AND length(t) > 1)")


@register("normalize_tokens", f"""SELECT doc_id, CAST(length({norm_answer_sql('text')}) AS INTEGER) AS norm_chars,
  CAST(len({answer_tokens_sql('text')}) AS INTEGER) AS n_tokens,
  CAST(len(list_distinct({answer_tokens_sql('text')})) AS INTEGER) AS n_distinct,
  md5(array_to_string({answer_tokens_sql('text')}, ' ')) AS tokens_md5
FROM documents""")
def normalize_tokens(spark, sf):
    """TXT-10 + TXT-11: answer normaliser and stop-word tokenizer over every document."""
    d = table(spark, sf, "documents", ["doc_id", "text"])
    toks = TX.answer_tokens("text")
    return d.select("doc_id", F.length(TX.normalize_answer("text")).alias("norm_chars"),
                    F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_distinct"),
                    F.md5(F.array_join(toks, " ")).alias("tokens_md5"))


SENT_SQL = (r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?•;]\s+'), "
            r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')")


@register("sentences", f"""WITH s AS (SELECT doc_id, {SENT_SQL} AS ss FROM documents),
u AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_pos, ss[i] AS sentence FROM u""")
def sentences(spark, sf):
    """TXT-16: sentence split with positions."""
    d = table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(TX.sentences("text")).alias("sent_pos", "sentence"))


@register("snippets", """SELECT doc_id,
  CASE WHEN length(text) > 280 THEN substring(text, 1, 280) || '…' ELSE text END AS snippet FROM documents""")
def snippets(spark, sf):
    """TXT-18: 280-character snippet with an ellipsis."""
    d = table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", TX.snippet("text").alias("snippet"))


@register("company_keys", r"""WITH s AS (SELECT DISTINCT source FROM documents),
k AS (SELECT source, upper(regexp_replace(coalesce(source, ''), '^\s+|\s+$', '', 'g')) AS key FROM s)
SELECT source, key, replace(key, ' ', '') AS ingest_key,
  CASE WHEN regexp_full_match(key, '[0-9]+') THEN CASE WHEN length(key) < 10 THEN lpad(key, 10, '0') ELSE key END END AS cik,
  CASE WHEN regexp_full_match(key, '[0-9]+') THEN NULL ELSE key END AS ticker
FROM k""")
def company_keys(spark, sf):
    """TXT-2: company key normalisation (CIK zero-padded for digit keys, else ticker)."""
    s = table(spark, sf, "documents", ["source"]).distinct()
    key = TX.company_key("source")
    digits = key.rlike(r"^[0-9]+$")
    return s.select("source", key.alias("key"), TX.company_key("source", drop_spaces=True).alias("ingest_key"),
                    F.when(digits, TX.zero_pad(key)).alias("cik"),
                    F.when(~digits, key).alias("ticker"))


def token_f1_sql(pred: str, gold: str) -> str:
    """DuckDB twin of functions.text.token_f1."""
    p, g = f"list_distinct({answer_tokens_sql(pred)})", f"list_distinct({answer_tokens_sql(gold)})"
    tp = f"len(list_intersect({p}, {g}))"
    return (f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0 "
            f"WHEN {tp} = 0 THEN 0.0 ELSE 2.0 * ({tp} / len({p})) * ({tp} / len({g})) / (({tp} / len({p})) + ({tp} / len({g}))) END")
