"""S10/S11 sinks and P3 id-or-count dispatch."""

import os
import tempfile

from prodtext.operators import catalog as C
from prodtext.sources import readers as RD
from prodtext.sources import sinks as SK
from prodtext.sources.fixtures import fixture


def test_product_json_and_text_sinks(spark, sf_dir):
    cat = fixture(spark, sf_dir, "catalog").limit(5)
    d = tempfile.mkdtemp(prefix="prodtext-test-", dir="/tmp")
    SK.write_product_json(cat, os.path.join(d, "json"), buckets=3)
    folders = [p for p in os.listdir(os.path.join(d, "json")) if p.startswith("bucket=")]
    assert 1 <= len(folders) <= 3
    for f in folders:
        assert len([p for p in os.listdir(os.path.join(d, "json", f)) if p.endswith(".json")]) == 1
    assert spark.read.json(os.path.join(d, "json")).select("product_id").distinct().count() == 5
    SK.write_text(cat, os.path.join(d, "txt"), "title")
    assert spark.read.text(os.path.join(d, "txt")).count() == 5


def test_sample_products_dispatch(spark, sf_dir):
    cat = fixture(spark, sf_dir, "catalog")
    one = cat.where("schema = 'small'").first().product_id
    # an existing id returns that product whatever its schema
    assert [r.product_id for r in C.sample_products(cat, one, "medium").collect()] == [one]
    n = C.sample_products(cat, 7, "medium")
    rows = n.collect()
    assert len(rows) == 7 and all(r.schema == "medium" for r in rows)
    assert [r.product_id for r in rows] == [r.product_id for r in C.sample_products(cat, 7, "medium").collect()]
    assert C.sample_products(cat, None, "medium").count() == 0


def test_json_arrays_are_bounded(spark):
    """A group is many lines, and its texts keep their order and places; null groups and texts too."""
    rows = [(g, i, None if i == 7 else "" if i == 8 else f"{g} \n\"{i}\" " + "x" * (i % 50)) for g, n in (("hot", 3000), ("b", 9), (None, 40)) for i in range(n)]
    rows += [("tie", 5, "same")] * 500 + [("tie", 5, "other")]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(5)
    path = os.path.join(tempfile.mkdtemp(prefix="prodtext-test-", dir="/tmp"), "arrays")
    SK.write_json_arrays(df, path, "text", "source", "doc_id", array_bytes=1000, chunk_rows=400)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) > 50 and max(map(len, lines)) < 4000
    got = {(r.group, r.doc_ord): r.text for r in RD.read_json_arrays(spark, path).collect()}
    assert len(got) == len(rows)
    want = {(g, i + 1): t for g, i, t in rows if g != "tie"}
    assert {k: t for k, t in got.items() if k[0] != "tie"} == want
    assert sorted(t for k, t in got.items() if k[0] == "tie") == ["other"] + ["same"] * 500
    assert sorted(k[1] for k in got if k[0] == "tie") == list(range(1, 502))


def test_csv_tells_null_from_empty(spark, tmp_path):
    from prodtext.sources import readers, sinks
    texts = [None, "", " ", " lead and trail ", 'a "quoted" word', "two\nlines\r\nthree", "a,b", '"', "\\", "\\N", "plain", "x\n"]
    rows = [(i, n, t) for i, t in enumerate(texts) for n in ("name", "", None)]
    df = spark.createDataFrame(rows, "_c0 long, name string, description string")
    sinks.write_descriptions_csv(df.coalesce(1), str(tmp_path / "csv"), rows_per_file=10)
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 4
    got = [tuple(r) for r in readers.read_descriptions_csv(spark, str(tmp_path / "csv")).select("name", "description").collect()]
    assert sorted(map(repr, got)) == sorted(repr((n, t)) for _, n, t in rows)
