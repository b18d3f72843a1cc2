"""Readers, sinks and the row-wise streaming runner, on data derived from the sf0.001 tables."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from prodtext.operators import annotate as A
from prodtext.sources import readers as RD
from prodtext.sources import sinks as SK
from prodtext.sources.fixtures import fixture
from prodtext.streaming.rowwise import stream_rowwise


def scratch():
    return tempfile.mkdtemp(prefix="prodtext-test-", dir="/tmp")


def test_json_array_and_annotation_corpora(spark, sf_dir):
    tagged = fixture(spark, sf_dir, "tagged").orderBy("doc_id").limit(20)
    texts = [r.tagged_text for r in tagged.collect()]
    d = scratch()
    with open(os.path.join(d, "corpus.json"), "w") as f:
        json.dump(texts, f)
    back = RD.read_json_string_array(spark, os.path.join(d, "corpus.json"))
    assert [r.text for r in back.orderBy("doc_ord").collect()] == texts
    SK.write_annotation_corpora(tagged, os.path.join(d, "out"))
    un = spark.read.json(os.path.join(d, "out", "untagged"))
    assert un.count() == 20
    assert un.where(F.col("text").contains("<attr>")).count() == 0


def test_line_list_keeps_blank_lines(spark):
    d = scratch()
    p = os.path.join(d, "list.txt")
    with open(p, "w") as f:
        f.write("bore\n\nrust-proof\ngauge\n")
    rows = RD.read_line_list(spark, p).orderBy("ord").collect()
    assert [(r.ord, r.value) for r in rows] == [(1, "bore"), (2, ""), (3, "rust-proof"), (4, "gauge")]


def test_csv_descriptions(spark, sf_dir):
    docs = fixture(spark, sf_dir, "descriptions").where("name IS NOT NULL AND description IS NOT NULL").limit(10)
    pdf = docs.toPandas()
    d = scratch()
    p = os.path.join(d, "final.csv")
    pdf[["name", "description"]].to_csv(p)  # writes the unnamed index column
    back = RD.read_descriptions_csv(spark, p)
    assert back.columns == ["name", "description"]
    assert sorted(r.description for r in back.collect()) == sorted(pdf["description"])


def test_json_props(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = RD.parse_json_column(ev, "props", "k INT").select("parsed.k")
    assert out.where(F.col("k").isNull()).count() == 0


def test_streaming_strip_tags(spark, sf_dir):
    tagged = fixture(spark, sf_dir, "tagged")
    src, sink = scratch(), scratch()
    tagged.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "in"))
    q = stream_rowwise(spark, os.path.join(src, "in"), tagged.schema, lambda df: A.strip_tags(df),
                       os.path.join(sink, "out"), name=os.path.basename(sink))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(sink, "out")).select("doc_id", "text")
    exp = A.strip_tags(tagged).select("doc_id", "text")
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
