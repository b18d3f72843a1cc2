"""What is shuffled and written on the way to extraction quality and training records."""

import random

from pyspark.sql import functions as F

from prodtext.operators import annotate as A
from prodtext.operators import spans as S
from prodtext.plans import annotation_queries as AQ
from prodtext.plans import corpus_queries as CQ


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_heads_are_not_shuffled_to_meet_the_marks(spark):
    index = spark.createDataFrame([("red fox",), ("é😀",), ("",)], "head string")
    heads = spark.createDataFrame([(1, "red fox"), (2, "é😀"), (3, "blue"), (4, None), (5, "")], "block int, head string")
    kept = A._marked(heads, A.head_marks(index))
    assert _exchanges(kept) == 0
    assert {r.block for r in kept.collect()} == {1, 2, 5}


def test_texts_get_their_folds_without_a_join(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "doc_id long, text string")
    for rows in (docs, docs.unionByName(docs.where("doc_id = 2"))):
        folds = AQ.folds_of(rows)
        got, want = AQ.in_folds(rows, folds), rows.join(folds, "doc_id")
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert _exchanges(AQ.in_folds(docs, AQ.folds_of(docs))) == 0


def test_predictions_are_shuffled_once_to_meet_the_gold_spans(spark):
    rnd = random.Random(3)
    def spans(n):
        return [(doc, start, start + rnd.randrange(0, 200), rnd.choice(["ATTR", "PROD"])) for doc in (1, 2) for start in (rnd.randrange(1000) for _ in range(n))]
    gold = [(d, i, s, e, label) for i, (d, s, e, label) in enumerate(spans(40))]
    pred = [(d, i, s, e, label) for i, (d, s, e, label) in enumerate(spans(80))] + [(3, 900, 1, 2, "ATTR"), (None, 901, 1, 2, "ATTR")]
    g = spark.createDataFrame(gold, "doc_id long, span_ord int, start int, end int, label string")
    m = S.span_match(spark.createDataFrame(pred, "doc_id long, pred_ord int, start int, end int, label string"), g)
    assert _exchanges(m) == 2
    got = {r.pred_ord: r.gold_ord for r in m.collect()}
    hit = lambda p, x: x[0] == p[0] and (x[2] <= p[3] <= x[3] or x[2] <= p[2] <= x[3])
    assert got == {p[1]: min((x[1] for x in gold if hit(p, x)), default=None) for p in pred} and None in got.values()


def test_counted_matches_give_the_same_counters(spark):
    g = spark.createDataFrame([(1, 1, 0, 5, "ATTR"), (1, 2, 9, 12, "PROD"), (2, 1, 0, 3, "ATTR")], "doc_id long, span_ord int, start int, end int, label string")
    p = spark.createDataFrame([(1, 1, 0, 5, "ATTR"), (1, 2, 1, 4, "PROD"), (1, 3, 1, 4, "PROD"), (2, 1, 50, 60, "ATTR")], "doc_id long, pred_ord int, start int, end int, label string")
    folds = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, fold int")
    got = {r.tag: (r.correct2, r.perfect, r.partial, r.misclassified, r.total_t, r.total_r, r.missed) for r in S.span_metrics(S.span_match(p, g), g, folds).collect()}
    assert got == {"ATTR": (1, 1, 0, 0, 2, 2, 1), "PROD": (0, 0, 2, 2, 2, 1, 1)}


def test_record_files_are_compressed(spark, sf_dir):
    path = CQ._record_files(spark, sf_dir)
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert files and all(r.path.endswith(".txt.gz") for r in files)
    assert spark.read.text(path).where(F.col("value").startswith("<OVERV_START>")).count() > 100
