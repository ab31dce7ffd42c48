"""Registered source / sink queries on the given tables: latest filing per group, bundle
fallback, catalog anti-join, cross delete-then-insert, ingest status, row counts, vector
literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.functions import vectors as V
from annualis.plans.q_text import html_text_sql
from annualis.plans.registry import register
from annualis.sinks import tables as SK
from annualis.sources import filings as SRC
from annualis.sources.tables import FILINGS_V_SQL, filings, table


@register("latest_per_group", """WITH o AS (
  SELECT o_custkey, o_orderkey, o_orderdate, TRY_CAST(substring(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS year
  FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, year ORDER BY CAST(o_orderdate AS VARCHAR) DESC, o_orderkey) AS rn
  FROM o WHERE year IS NOT NULL)
SELECT o_custkey, year, o_orderkey, o_orderdate FROM r WHERE rn = 1""")
def latest_per_group(spark, sf):
    """SRC-1 / WIN-13 shape: newest 'F' order per (customer, year of the date string), ties in key order."""
    o = table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"])
    out = SRC.latest_by_year(o, ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderstatus", "F")
    return out.select("o_custkey", "year", "o_orderkey", "o_orderdate")


@register("bundle_text", f"""WITH cat AS (SELECT doc_id FROM documents),
txt AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
htm AS (SELECT page_id AS doc_id, html FROM pages),
j AS (SELECT cat.doc_id, txt.text AS t, htm.html AS h FROM cat LEFT JOIN txt USING (doc_id) LEFT JOIN htm USING (doc_id))
SELECT doc_id, CASE WHEN t IS NOT NULL THEN 'txt' WHEN h IS NOT NULL THEN 'html' END AS text_source,
  CAST(length(coalesce(t, {html_text_sql('h')})) AS INTEGER) AS text_chars
FROM j WHERE coalesce(t, {html_text_sql('h')}) IS NOT NULL""")
def bundle_text(spark, sf):
    """SRC-3 / JN-9: every catalog id gets its text file (English documents), else its cleaned page, else is skipped."""
    docs = table(spark, sf, "documents", ["doc_id", "text", "lang"])
    cat = docs.select("doc_id")
    txt = docs.filter(F.col("lang") == "en").select("doc_id", "text")
    html = table(spark, sf, "pages", ["page_id", "html"]).withColumnRenamed("page_id", "doc_id")
    out = SRC.bundle_text(cat, txt, html)
    return out.select("doc_id", "text_source", F.length("text").alias("text_chars"))


@register("catalog_antijoin", f"""WITH {FILINGS_V_SQL},
existing AS (SELECT doc_id, company, year FROM filings_v WHERE year <= 2021),
batch AS (SELECT doc_id, company, year, length(text) AS text_chars FROM filings_v WHERE year >= 2021)
SELECT b.doc_id, b.company, b.year, CAST(b.text_chars AS INTEGER) AS text_chars FROM batch b
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.doc_id = b.doc_id AND e.company = b.company AND e.year = b.year)""")
def catalog_antijoin(spark, sf):
    """SNK-2 / JN-6 / SET-3: a new batch (years >= 2021) appended to a catalog (years <= 2021): only unseen keys."""
    fil = filings(spark, sf)
    existing = fil.filter(F.col("year") <= 2021).select("doc_id", "company", "year")
    batch = fil.filter(F.col("year") >= 2021).select("doc_id", "company", "year", F.length("text").alias("text_chars"))
    return SK.unseen_catalog_rows(batch, existing)


@register("cross_delete_reload", f"""WITH {FILINGS_V_SQL},
f AS (SELECT f.doc_id, f.company, f.year, d.lang FROM filings_v f JOIN documents d USING (doc_id)),
old AS (SELECT doc_id, company, year, 'old' AS origin FROM f),
batch AS (SELECT doc_id, company, year, 'batch' AS origin FROM f WHERE lang = 'de'),
kept AS (SELECT * FROM old WHERE company NOT IN (SELECT company FROM batch) OR year NOT IN (SELECT year FROM batch)),
r AS (SELECT * FROM kept UNION ALL SELECT * FROM batch)
SELECT company, year, count(*) AS n_rows, CAST(sum(CASE WHEN origin = 'batch' THEN 1 ELSE 0 END) AS BIGINT) AS n_batch
FROM r GROUP BY company, year""")
def cross_delete_reload(spark, sf):
    """SNK-6 / JN-7: reload a batch (the German documents): every old row of a batch company AND a batch year is deleted first."""
    fil = filings(spark, sf).join(table(spark, sf, "documents", ["doc_id", "lang"]), "doc_id")
    old = fil.select("doc_id", "company", "year", F.lit("old").alias("origin"))
    batch = fil.filter(F.col("lang") == "de").select("doc_id", "company", "year", F.lit("batch").alias("origin"))
    r = SK.delete_then_insert(old, batch)
    return r.groupBy("company", "year").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.sum((F.col("origin") == "batch").cast("long")).alias("n_batch"))


@register("ingest_status", f"""WITH {FILINGS_V_SQL},
req AS (SELECT DISTINCT replace(upper(regexp_replace(company, '^\\s+|\\s+$', '', 'g')), ' ', '') AS company FROM filings_v),
yrs AS (SELECT unnest(range(2019, 2025)) AS year),
cnt AS (SELECT company, year, count(*) AS files FROM filings_v GROUP BY company, year)
SELECT r.company, CAST(y.year AS INTEGER) AS year, coalesce(c.files, 0) AS files,
  CASE WHEN coalesce(c.files, 0) > 0 THEN 'stamped' ELSE 'missing' END AS status
FROM req r CROSS JOIN yrs y LEFT JOIN cnt c ON c.company = r.company AND c.year = y.year""")
def ingest_status(spark, sf):
    """STR-1 (batch) / AGG-8 / JN-8: requested company x year pairs (2019-2024) with their file counts: stamped or missing."""
    fil = filings(spark, sf)
    req = fil.select(TX.company_key("company", drop_spaces=True).alias("company")).distinct()
    pairs = req.select("company", F.explode(F.sequence(F.lit(2019), F.lit(2024))).alias("year"))
    cnt = fil.groupBy("company", "year").agg(F.count(F.lit(1)).alias("files"))
    out = pairs.join(cnt, ["company", "year"], "left")
    files = F.coalesce(F.col("files"), F.lit(0)).cast("long")
    return out.select("company", F.col("year").cast("int").alias("year"), files.alias("files"),
                      F.when(files > 0, F.lit("stamped")).otherwise(F.lit("missing")).alias("status"))


@register("row_count", f"""WITH {FILINGS_V_SQL}
SELECT coalesce(company, '*') AS company, year, count(*) AS n FROM filings_v GROUP BY GROUPING SETS ((), (company, year))""")
def row_count(spark, sf):
    """SRC-12: row count of the chunk table, total and per (company, year)."""
    fil = filings(spark, sf)
    per = fil.groupBy("company", "year").agg(F.count(F.lit(1)).alias("n"))
    tot = fil.agg(F.lit("*").alias("company"), F.lit(None).cast("int").alias("year"), F.count(F.lit(1)).alias("n"))
    return per.unionByName(tot)


@register("vector_literal", """SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS literal,
  CAST(len(embedding) AS INTEGER) AS dim FROM embeddings""")
def vector_literal(spark, sf):
    """TXT-9: vector-store literal of every embedding, 6 decimals, and the length of its parse back."""
    e = table(spark, sf, "embeddings", ["vec_id", "embedding"])
    lit = V.vector_literal("embedding")
    return e.select("vec_id", lit.alias("literal"), F.size(V.parse_vector_literal(lit)).alias("dim"))
