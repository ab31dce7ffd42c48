"""Readers and writers on small files (SRC-4..9, SNK-3/8, TXT-20 post-process)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from annualis.functions import text as TX
from annualis.sinks import tables as SK
from annualis.sources import filings as SRC


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_catalog_required_columns(spark, tmpdir_path):
    ok = _write(os.path.join(tmpdir_path, "cat.csv"), "doc_id,company,year,primary_url\nd1, AAPL ,2023,u\n")
    df = SRC.read_catalog(spark, ok)
    r = df.first()
    assert (r.company, r.year) == ("AAPL", 2023)
    bad = _write(os.path.join(tmpdir_path, "bad.csv"), "doc_id,company\nd1,AAPL\n")
    with pytest.raises(ValueError, match="year"):
        SRC.read_catalog(spark, bad)


def test_chunk_csv_roundtrip(spark, tmpdir_path):
    chunks = spark.createDataFrame([(0, "d1", "A", 2023, 'line one\nline "two", end')],
                                   "chunk_id long, doc_id string, company string, year int, text string")
    out = os.path.join(tmpdir_path, "out")
    SK.write_chunks(chunks, out)
    back = SRC.read_chunks(spark, SK.chunks_out_path(out))
    assert back.first().text == 'line one\nline "two", end'
    assert SK.chunks_out_path("x/y.csv") == "x/y.csv"


def test_alias_tolerant_chunks(spark):
    df = spark.createDataFrame([("", "MSFT", "x", "", "hello", "2023"), ("A", None, None, "doc9", "", "bad")],
                               "company string, ticker string, chunk string, doc string, text string, year string")
    got = [tuple(r) for r in SRC.alias_tolerant_chunks(df).collect()]
    assert got == [("MSFT", 2023, 0, "", "hello"), ("A", 0, 0, "doc9", "")]


def test_resolve_text_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, content string, text string")
    assert SRC.resolve_text_column(df, "text") == "text"
    assert SRC.resolve_text_column(df, "missing") == "content"
    with pytest.raises(ValueError):
        SRC.resolve_text_column(df.select("id"))


def test_qa_jsonl(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "qa.jsonl"),
               '{"question": "q1", "ground_truth": "g1"}\n\n{"q": "q2", "answer": "a2"}\n{"question": "", "q": "q3"}\n')
    got = [(r.q_text, r.gold) for r in SRC.read_qa(spark, p).collect()]
    assert got == [("q1", "g1"), ("q2", "a2"), ("q3", "")]


def test_corpus_shapes(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "a.json"), json.dumps({"chunks": ["t1", "t2"], "meta": [{"company": "A"}, {"company": "B"}]}))
    got = [(r.text, r.meta["company"]) for r in SRC.read_corpus(spark, a).collect()]
    assert got == [("t1", "A"), ("t2", "B")]
    b = _write(os.path.join(tmpdir_path, "b.json"), json.dumps({"records": [{"chunk": "c1", "company": "A", "year": 2023}]}))
    r = SRC.read_corpus(spark, b).first()
    assert r.text == "c1" and r.meta["company"] == "A" and r.meta["year"] == "2023"
    c = _write(os.path.join(tmpdir_path, "c.json"), json.dumps([{"content": "x", "meta": {"k": "v"}}]))
    r = SRC.read_corpus(spark, c).first()
    assert r.text == "x" and r.meta == {"k": "v"}


def test_eval_set_write(spark, tmpdir_path):
    items = spark.createDataFrame([("q", "A", 2023)], "question string, company string, year int")
    SK.write_eval_set(items, os.path.join(tmpdir_path, "ev"))
    assert spark.read.json(os.path.join(tmpdir_path, "ev")).count() == 1


def test_answer_after_marker(spark):
    df = spark.createDataFrame([("ctx Answer: a Answer:  azure \n",), ("no marker",)], "s string")
    assert [r[0] for r in df.select(TX.answer_after_marker(F.col("s"))).collect()] == ["azure", "no marker"]


def test_configuration_file_missing_file_and_defaults(spark, tmpdir_path):
    empty = SRC.read_config(spark, os.path.join(tmpdir_path, "none.json"))
    assert empty == SRC.read_config(spark, None) == {"segments": {}, "driver_regex": SRC.DEFAULT_DRIVER_REGEX}
    p = _write(os.path.join(tmpdir_path, "c.json"), json.dumps({"segments": {"Cloud": ["Azure", "SQL"]}}))
    assert SRC.read_config(spark, p) == {"segments": {"Cloud": ["azure", "sql"]}, "driver_regex": SRC.DEFAULT_DRIVER_REGEX}
    tables = SRC.config_tables(spark, p)
    assert [tuple(r) for r in tables["segments"].orderBy("kw_pos").collect()] == [("Cloud", "azure", 0), ("Cloud", "sql", 1)]
    assert tables["patterns"].first()["pattern"] == SRC.DEFAULT_DRIVER_REGEX[0]
    y = _write(os.path.join(tmpdir_path, "c.yml"), "driver_regex:\n  - 'because of (.+)'\n")
    pytest.importorskip("yaml")
    assert SRC.read_config(spark, y)["driver_regex"] == ["because of (.+)"]
    with pytest.raises(ValueError):
        SRC.read_config(spark, _write(os.path.join(tmpdir_path, "d.json"), "[1]"))


def test_lookup_corpus_aliases_and_years(spark):
    rows = [(1, "t", {"company": "A", "Company": "B", "year": "2020"}), (2, None, {"company": "", "Company": "B", "Year": " 2021 "}),
            (3, "t", {"ticker": "C", "year": "2021.5"}), (4, "t", {}), (5, "t", None), (6, "t", {"company": "A", "year": "99999999999"})]
    got = SRC.lookup_corpus(spark.createDataFrame(rows, "doc_id long, text string, meta map<string,string>")).orderBy("doc_id").collect()
    assert [(r.company, r.year, r.text) for r in got] == [("A", 2020, "t"), ("B", 2021, ""), ("C", None, "t"), ("", None, "t"), ("", None, "t"), ("A", None, "t")]


def test_catalog_records(spark):
    df = spark.createDataFrame([("d1", " acme ", "2020", "one  two"), ("d2", None, "x", None)], "doc_id string, company string, year string, text string")
    df = df.withColumn("year", F.col("year").try_cast("int"))
    got = [(r.doc_id, r.company, r.year, r.text_chars, r.text_words) for r in SRC.catalog_records(df).orderBy("doc_id").collect()]
    assert got == [("d1", "ACME", 2020, 8, 2), ("d2", "", None, 0, 0)]
