"""The pipeline: each stage against a plain version on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from prodtext.llm import simhash, toxicity
from prodtext.llm.common import cut

from .test_decontamination import brute
from .test_simhash import brute_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input, output) of each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in P.STAGES:
        result = cut(f(spark, docs, sf_dir))
        out.append((name, docs, result))
        docs = result
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages, documents):
    assert [n for n, _, _ in stages] == ["toxicity", "simhash near-dedup", "decontamination", "mixing", "sharding"]
    for _, _, out in stages[:-1]:
        assert out.columns == documents.columns


def test_toxicity(spark, sf_dir, stages):
    _, docs, out = stages[0]
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert ids(out) == sorted(i for i, s in scores.items() if s < 0.5) and 0 < out.count() < docs.count()
    assert out.exceptAll(docs).count() == 0


def test_near_duplicates(stages):
    _, docs, out = stages[1]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert ids(out) == sorted(set(brute_components(prints).values())) and out.exceptAll(docs).count() == 0


def test_decontamination(spark, sf_dir, stages):
    _, docs, out = stages[2]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[s:s + min(10, len(w))]) for _, t in bench for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for s in range(max(1, len(w) - 9))}
    clean = []
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        if not any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert ids(out) == sorted(clean) and len(clean) < docs.count()
    assert brute([(1, bench[0][1])], bench, 10)[1][1] > 0


def test_mixing_and_sharding(stages):
    _, docs, mixed = stages[3]
    words = lambda df: df.select("source", F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    before, after = ({r.source: r.n for r in words(x).collect()} for x in (docs, mixed))
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), rel=0.01)
    assert all(after[s] <= 2 * before[s] for s in before)
    _, docs, out = stages[4]
    assert out.count() == docs.count()
    for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("z")).collect():
        assert r.n == r.d and (r.a, r.z) == (0, r.n - 1)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert E.queries()["pipeline"](spark, sf_dir).exceptAll(stages[-1][2]).count() == 0


def test_stages_on_edges(spark, sf_dir, edge_docs, empty_docs):
    for docs in (edge_docs, empty_docs):
        at = cut(docs)
        for _, f in P.STAGES[:-1]:
            at = cut(f(spark, at, sf_dir))
            assert at.columns == docs.columns
        assert P.STAGES[-1][1](spark, at, sf_dir).count() == at.count()


def test_repeated_rows_leave_one(spark):
    docs = cut(spark.createDataFrame([(1, "same words here today")] * 3 + [(2, "Same words HERE today")], "doc_id long, text string"))
    assert P.drop_near_duplicates(spark, docs, "").count() == 1
    assert sum(r.kept for r in simhash.near_duplicates(docs).collect()) == 1


@pytest.mark.parametrize("stage, module, operator", [("drop_near_duplicates", P.simhash, "near_duplicates"), ("drop_contaminated", P.decontamination, "decontaminate"), ("mix", P.mixing, "mix_sources")])
def test_splits_that_change_between_readings(spark, sf_dir, documents, monkeypatch, tmp_path, stage, module, operator):
    """Row ids hold when the table is split otherwise after the operator has read it."""
    documents.repartition(6).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    want = sorted(map(tuple, cut(getattr(P, stage)(spark, docs, sf_dir)).select("doc_id", "text").collect()))
    plain, cost = getattr(module, operator), spark.conf.get("spark.sql.files.openCostInBytes")

    def then_resplit(*args, **options):
        out = cut(plain(*args, **options))
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a file each
        return out

    monkeypatch.setattr(module, operator, then_resplit)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = sorted(map(tuple, cut(getattr(P, stage)(spark, docs, sf_dir)).select("doc_id", "text").collect()))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == want
