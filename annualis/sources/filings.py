"""Filing sources (SRC-1..11): submissions feed, ticker map, bundles, catalog, chunk and
QA files, corpus shapes, config tables.  All readers are ``spark.read`` calls plus
column expressions; per-row errors skip the row (permissive modes / try_cast)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annualis import config as C
from annualis.functions import text as TX
from annualis.session import bounded_broadcast, path_exists
from annualis.sources.records import json_objects, pieces, read_multiline_csv

SUBMISSIONS_SCHEMA = T.StructType([
    T.StructField("cik", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("filings", T.StructType([T.StructField("recent", T.StructType([
        T.StructField("form", T.ArrayType(T.StringType())),
        T.StructField("accessionNumber", T.ArrayType(T.StringType())),
        T.StructField("primaryDocument", T.ArrayType(T.StringType())),
        T.StructField("filingDate", T.ArrayType(T.StringType())),
    ]))])),
])


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submissions feed files (one JSON object per company)."""
    return spark.read.schema(SUBMISSIONS_SCHEMA).option("multiLine", "true").json(path)


def latest_by_year(df: DataFrame, keys: list[str], date_col: str, order_col: str, form_col: str | None = None,
                   form: str | None = None) -> DataFrame:
    """SRC-1 / WIN-13 core: keep ``form`` exactly, derive the year from the first four
    characters of the date (unparseable -> row dropped), newest date per (keys, year);
    ties keep the earlier ``order_col`` (feed order)."""
    d = df
    if form_col is not None:
        d = d.filter(F.col(form_col) == F.lit(form))
    yr = F.expr(f"try_cast(substr(cast({date_col} as string), 1, 4) as int)")
    d = d.withColumn("year", yr).filter(F.col("year").isNotNull())
    w = Window.partitionBy(*keys, "year").orderBy(F.col(date_col).cast("string").desc(), F.col(order_col))
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pick_latest_filing(subm: DataFrame, years: list[int] | None = None, form: str = "10-K") -> DataFrame:
    """SRC-1: unzip the parallel arrays (position kept as feed order) and pick, per
    company and year, the newest ``form`` filing.  ``years`` limits the result."""
    r = F.col("filings.recent")
    rows = subm.select("cik", F.posexplode(F.arrays_zip(r["form"], r["accessionNumber"], r["primaryDocument"],
                                                      r["filingDate"])).alias("pos", "f"))
    rows = rows.select("cik", "pos", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"),
                       F.col("f.primaryDocument").alias("primary_doc"), F.col("f.filingDate").alias("filing_date"))
    out = latest_by_year(rows, ["cik"], "filing_date", "pos", "form", form)
    if years:
        out = out.filter(F.col("year").isin(years))
    return out


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2 input: a JSON object {"0": {"cik_str": .., "ticker": .., "title": ..}, ...}."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>")
    return raw.select(F.explode(m).alias("k", "v")).select(
        F.col("k").cast("long").alias("pos"), F.col("v.ticker").alias("ticker"), F.col("v.cik_str").alias("cik_str"))


def lookup_cik(requests: DataFrame, tickers: DataFrame, col: str = "ticker") -> DataFrame:
    """SRC-2: case-insensitive ticker -> CIK zero-padded to 10; first map entry wins;
    no match -> null.  The ticker map (~10k rows) is broadcast if it is as small as that."""
    t = tickers.select(F.upper("ticker").alias("_t"), "pos", "cik_str")
    first = t.withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy("pos"))).filter("_r = 1")
    out = requests.join(bounded_broadcast(first.select("_t", "cik_str")), F.upper(F.col(col)) == F.col("_t"), "left")
    return out.select(*requests.columns, TX.zero_pad(F.col("cik_str").cast("string")).alias("cik"))


def primary_url(cik: Column, accession: Column, primary: Column) -> Column:
    """TXT-3: archive URL from CIK (as integer), accession without dashes, document name."""
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"),
                    F.translate(accession, "-", ""), F.lit("/"), primary)


def bundle_text(catalog: DataFrame, txt: DataFrame, html: DataFrame, key: str = "doc_id") -> DataFrame:
    """SRC-3 / JN-9: text file if present, else the cleaned HTML, else the row is skipped."""
    j = (catalog.join(txt.select(key, F.col("text").alias("_txt")), key, "left")
         .join(html.select(key, F.col("html").alias("_html")), key, "left"))
    text = F.coalesce(F.col("_txt"), TX.html_to_text(F.col("_html")))
    src = F.when(F.col("_txt").isNotNull(), F.lit("txt")).when(F.col("_html").isNotNull(), F.lit("html"))
    return j.select(*catalog.columns, text.alias("text"), src.alias("text_source")).filter(F.col("text").isNotNull())


REQUIRED_CATALOG = {"doc_id", "company", "year"}
REQUIRED_CHUNKS = {"chunk_id", "doc_id", "company", "year", "text"}


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: catalog CSV with a required-column check; company trimmed, year to int."""
    df = spark.read.option("header", "true").csv(path)
    miss = REQUIRED_CATALOG - set(df.columns)
    if miss:
        raise ValueError(f"{path} missing columns: {sorted(miss)}")
    return df.withColumn("company", TX.strip_ws("company")).withColumn("year", F.col("year").cast("int"))


def read_chunks(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC-5: chunk file (CSV with quoted multi-line text, read in byte ranges, or Parquet)."""
    if fmt == "csv":
        df = read_multiline_csv(spark, path)
    else:
        df = spark.read.parquet(path)
    miss = REQUIRED_CHUNKS - set(df.columns)
    if miss:
        raise ValueError(f"{path} missing columns: {sorted(miss)}")
    return df.withColumn("year", F.col("year").cast("int")).withColumn("chunk_id", F.col("chunk_id").cast("long"))


def _first_nonempty(df: DataFrame, names: list[str], default) -> Column:
    cols = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*cols, F.lit(default)) if cols else F.lit(default)


def alias_tolerant_chunks(df: DataFrame) -> DataFrame:
    """SRC-6: company <- company|ticker, source_doc <- source_doc|doc|doc_id, text <- text|chunk,
    year / chunk_id default 0 (empty strings count as missing)."""
    def int_or0(n):
        return F.coalesce(F.expr(f"try_cast({n} as int)"), F.lit(0)) if n in df.columns else F.lit(0)
    return df.select(
        _first_nonempty(df, ["company", "ticker"], "").alias("company"),
        int_or0("year").alias("year"), int_or0("chunk_id").alias("chunk_id"),
        _first_nonempty(df, ["source_doc", "doc", "doc_id"], "").alias("source_doc"),
        _first_nonempty(df, ["text", "chunk"], "").alias("text"),
    )


def resolve_text_column(df: DataFrame, preferred: str | None = None) -> str:
    """SRC-9: preferred column if present, else the first of chunk, content, text, passage, body."""
    if preferred and preferred in df.columns:
        return preferred
    for c in ["chunk", "content", "text", "passage", "body"]:
        if c in df.columns:
            return c
    raise ValueError(f"could not determine the text column; existing columns: {df.columns}")


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: QA JSONL (blank lines skipped): question <- question|q, gold <- ground_truth|answer."""
    df = spark.read.json(path)
    return df.select(
        "*",
        _first_nonempty(df, ["question", "q"], "").alias("q_text"),
        _first_nonempty(df, ["ground_truth", "answer"], "").alias("gold"),
    )


def corpus_records(df: DataFrame) -> DataFrame:
    """SRC-7 (list-of-dicts shape): text <- text|chunk|content|first string column;
    meta <- the given ``meta`` map, else every other column as a string map."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    text = _first_nonempty(df, ["text", "chunk", "content"] + strings[:1], "")
    if "meta" in df.columns:
        meta = F.col("meta")
    else:
        rest = [c for c in df.columns if c not in {"text", "chunk", "content"}]
        meta = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else \
            F.create_map().cast("map<string,string>")
    return df.select(F.coalesce(text, F.lit("")).alias("text"), meta.alias("meta"))


def _corpus_objects(objects: DataFrame) -> DataFrame:
    """(text, meta) of JSON objects given as text: text <- text|chunk|content|first string value, whichever is
    not empty first; meta is the object's own, else its other fields."""
    fields = F.from_json("text", "map<string,string>")
    typed = F.from_json("text", "map<string,variant>")
    strings = F.filter(F.map_values(typed), lambda v: F.schema_of_variant(v) == "STRING")
    named = [F.nullif(fields[n], F.lit("")) for n in ("text", "chunk", "content")]
    text = F.coalesce(*named, F.try_element_at(strings, F.lit(1)).cast("string"), F.lit(""))
    rest = F.map_filter(fields, lambda k, _: ~k.isin("text", "chunk", "content", "meta"))
    return objects.select(text.alias("text"), F.coalesce(F.from_json(fields["meta"], "map<string,string>"), rest).alias("meta"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: normalise a JSON corpus file to (text, meta map) rows.  Shapes: a list or lines of objects and
    {"records": [...]} (text|chunk|content|first string field; meta given or the rest), read in byte
    ranges; {"chunks": [...], "meta": [...]} (parallel lists) and [[text, meta], ...] (pairs), read a
    file a task.  Other shapes are an error."""
    heads = pieces(spark, path, "}").select("range", "seq", F.substring("v", 1, 1000).alias("v"))
    first = heads.orderBy("range", "seq").limit(1).collect()
    head = first[0]["v"].lstrip("\ufeff \t\r\n") if first else ""
    empty = spark.createDataFrame([], "text string, meta map<string,string>")
    if re.match(r"\[\s*\]", head):
        return empty
    if re.match(r"\[\s*\{", head):
        return _corpus_objects(json_objects(spark, path, 1))
    if re.match(r'\{\s*"records"\s*:\s*\[', head):
        return _corpus_objects(json_objects(spark, path, 2))
    if re.match(r"\[\s*\[", head):
        pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
        meta = F.coalesce(F.from_json(F.get("p", F.lit(1)), "map<string,string>"), F.create_map().cast("map<string,string>"))
        return pairs.select(F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("text"), meta.alias("meta"))
    if head.startswith("{"):
        df = spark.read.option("multiLine", "true").json(path)
        lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        if {"chunks", "meta"} <= lists:
            z = df.select(F.inline(F.arrays_zip(F.col("chunks").alias("text"), F.col("meta").alias("meta"))))
            meta = F.from_json(F.to_json("meta"), "map<string,string>")
            return z.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), meta.alias("meta"))
        if any(isinstance(f.dataType, T.StringType) and f.name != "_corrupt_record" for f in df.schema.fields):
            return _corpus_objects(json_objects(spark, path, 0))
    raise ValueError(f"{path}: unknown corpus shape")


def lookup_corpus(corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """FLT-2 input: (id, company, year, text) of corpus rows (id, text, meta map).  company is the first
    of the meta's company, Company and ticker that is not empty; year the first of year and Year, as an
    integer; a year that is none never equals one that is asked for (null)."""
    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col("meta")[n], F.lit("")) for n in names], F.lit(""))
    year = TX.strip_ws(first("year", "Year"))
    return corpus.select(id_col, first("company", "Company", "ticker").alias("company"),
                         F.when(year.rlike(r"^[+-]?[0-9]+$"), year.try_cast("int")).alias("year"),
                         F.coalesce("text", F.lit("")).alias("text"))


#: Pattern used when a configuration names none.
DEFAULT_DRIVER_REGEX = [r"(?:driven by|led by|due to)\s+([^.;:\n]+)"]


def read_config(spark: SparkSession, path: str | None) -> dict:
    """SRC-10: {"segments": {name: [words]}, "driver_regex": [patterns]} from a JSON file, or a YAML one
    where that library is installed.  No path and a missing file are an empty configuration: no segments
    and the default pattern.  Keywords are lower-cased."""
    import json

    raw: dict = {}
    if path and path_exists(spark, path):
        text = spark.read.text(path, wholetext=True).first()["value"]
        if path.endswith((".yml", ".yaml")):
            import yaml
            raw = yaml.safe_load(text) or {}
        else:
            raw = json.loads(text or "{}")
        if not isinstance(raw, dict):
            raise ValueError(f"{path}: not a table of settings")
    return {"segments": {k: [str(w).lower() for w in ws] for k, ws in (raw.get("segments") or {}).items()},
            "driver_regex": list(raw.get("driver_regex") or DEFAULT_DRIVER_REGEX)}


def config_tables(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """SRC-10: segments, questions and patterns as small tables; of the built-in values, or of a
    configuration file if one is named (the questions are always the built-in ones)."""
    if path is None:
        return {"segments": C.segments_df(spark), "questions": C.questions_df(spark),
                "patterns": C.driver_patterns_df(spark)}
    cfg = read_config(spark, path)
    rows = [(seg, kw, i) for seg, kws in cfg["segments"].items() for i, kw in enumerate(kws)]
    return {"segments": spark.createDataFrame(rows, "segment string, keyword string, kw_pos int"),
            "questions": C.questions_df(spark), "patterns": C.driver_patterns_df(spark, cfg["driver_regex"])}


def catalog_records(bundles: DataFrame, key: str = "doc_id") -> DataFrame:
    """TXT-4: the catalog row of every bundle text: (key, company, year, text, text_chars, text_words)."""
    text = F.coalesce("text", F.lit(""))
    return bundles.select(key, TX.company_key("company").alias("company"), F.col("year").cast("int").alias("year"), text.alias("text"),
                          F.length(text).alias("text_chars"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("text_words"))
