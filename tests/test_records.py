"""Records of one large file read in many byte ranges equal those of a single reader."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from annualis.sources import filings as SRC
from annualis.sources import records as RC


@pytest.fixture()
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def _texts(rng, n):
    parts = ["plain", 'a "quoted" word', "two\nlines", 'odd " mark\n', "", ", comma", "}{][", "\\", 'end\\"', "é中", "\n\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_ranges(spark, tmpdir_path, small_ranges, end):
    rng = random.Random(1)
    rows = [[str(i), f"D{i}", " Acme ", str(2020 + i % 3), t] for i, t in enumerate(_texts(rng, 300))]
    path = f"{tmpdir_path}/chunks.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["chunk_id", "doc_id", "company", "year", "text"])
        w.writerows(rows)
    cut = RC.pieces(spark, path, "\n")
    assert cut.rdd.getNumPartitions() > 10 and cut.select("range").distinct().count() > 10
    got = SRC.read_chunks(spark, path)
    assert got.dtypes[0] == ("chunk_id", "bigint") and got.dtypes[3] == ("year", "int")
    back = {str(r.chunk_id): (r.text or "") for r in got.collect()}
    assert back == {r[0]: r[4] for r in rows}
    with open(f"{tmpdir_path}/other.csv", "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        SRC.read_chunks(spark, f"{tmpdir_path}/other.csv")
    open(f"{tmpdir_path}/empty.csv", "w").close()
    with pytest.raises(ValueError, match="no header"):
        SRC.read_chunks(spark, f"{tmpdir_path}/empty.csv")


@pytest.mark.parametrize("shape", ["list", "pretty", "records", "lines"])
def test_json_objects_in_ranges(spark, tmpdir_path, small_ranges, shape):
    rng = random.Random(2)
    objects = [{"id": i, "text": t, "meta": {"year": i, "tags": ["}", "[", {"x": t}]}} for i, t in enumerate(_texts(rng, 200))]
    path = f"{tmpdir_path}/{shape}.json"
    text = {"list": json.dumps(objects), "pretty": json.dumps(objects, indent=2, ensure_ascii=False) + "\n",
            "records": json.dumps({"records": objects}, indent=1), "lines": "\n".join(map(json.dumps, objects))}[shape]
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    got = RC.json_objects(spark, path, {"records": 2, "lines": 0}.get(shape, 1)).orderBy("record").collect()
    assert [json.loads(r.text) for r in got] == objects


def test_corpus_shapes_give_pairs(spark, tmpdir_path, small_ranges):
    objects = [{"chunk": f"text {i}\n}}", "Company": "A", "year": i} for i in range(80)]
    shapes = {"a": objects, "b": {"records": objects}, "c": {"chunks": [o["chunk"] for o in objects], "meta": [{"Company": "A", "year": o["year"]} for o in objects]}}
    for name, value in shapes.items():
        path = f"{tmpdir_path}/{name}.json"
        with open(path, "w") as f:
            json.dump(value, f, indent=1)
        rows = SRC.read_corpus(spark, path).orderBy(F.col("meta")["year"].cast("int")).collect()
        assert [(r.text, r.meta["Company"], r.meta["year"]) for r in rows] == [(o["chunk"], "A", str(o["year"])) for o in objects]
    with open(f"{tmpdir_path}/pairs.json", "w") as f:
        json.dump([["one", {"year": 1}], ["two", None]], f)
    assert [(r.text, r.meta) for r in SRC.read_corpus(spark, f"{tmpdir_path}/pairs.json").collect()] == [("one", {"year": "1"}), ("two", {})]
    for bad in ('"just a text"', "17", '{"other": [1]}'):
        with open(f"{tmpdir_path}/bad.json", "w") as f:
            f.write(bad)
        with pytest.raises(ValueError, match="unknown corpus shape"):
            SRC.read_corpus(spark, f"{tmpdir_path}/bad.json").collect()
