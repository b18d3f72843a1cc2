"""Quality and toxicity: solvers against plain formulas, held-out accuracy, edges."""

import re
import zlib

import numpy as np
import pytest

from prodtext.llm import labelled, quality, toxicity


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x @ rng.normal(size=5) + 0.3 * rng.normal(size=60) > 0).astype(float)
    rows, values = [np.arange(5)] * 60, [v for v in x]
    w = quality.dual_descent(rows, values, y, 5, epochs=400)
    sign = np.where(y == 1, 1, -1)

    def objective(w):
        return 0.5 * w @ w + np.sum(np.maximum(0, 1 - sign * (x @ w[:5] + w[5])) ** 2)

    best = objective(w)
    for _ in range(200):
        assert objective(w + 0.01 * rng.normal(size=6)) >= best - 1e-6


def test_log_count_ratio_by_hand():
    rows, y = [np.array([0, 1]), np.array([0]), np.array([2])], np.array([1.0, 1.0, 0.0])
    p, q = np.array([3, 2, 1, 1]) / 7, np.array([1, 1, 2, 1]) / 5
    assert quality.log_count_ratio(rows, y, 4) == pytest.approx(np.log(p) - np.log(q))


def test_machine_sums_all_pairs():
    m = toxicity.Machine(20, 3, np.arange(6), np.ones(6))
    m.weight[:], m.bias = np.arange(6) / 10, 0.25
    ids = np.array([0, 2, 5])
    pairs = sum(m.factor[i] @ m.factor[j] for a, i in enumerate(ids) for j in ids[a + 1:])
    assert m.raw(ids) == pytest.approx(0.25 + m.weight[ids].sum() + pairs)


def test_machine_learns_what_only_a_pair_tells():
    """Neither term tells anything alone; an additive model cannot do better than half."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    rows = [np.flatnonzero([u, v, True]) for u, v in zip(a, b)]
    y = (a == b).astype(float)
    m = toxicity.Machine(20, 4, np.arange(3), np.ones(3))
    m.train(rows, y, epochs=60, decay=1e-4)
    assert np.mean([(m.raw(r) > 0) == t for r, t in zip(rows, y)]) > 0.95


def test_fit_learns_a_pair_of_neutral_words():
    """Label 1: both of two words or neither; each is in half of the texts of either label."""
    rng = np.random.default_rng(5)
    filler = [f"word{i}x" for i in range(300)]
    texts, y = [], []
    for _ in range(4000):
        a, b = rng.integers(0, 2, 2)
        words = [*rng.choice(filler, 12), *["quarrel"] * a, *["neighbour"] * b]
        texts.append(" ".join(rng.permutation(words)))
        y.append(float(a == b))
    rows, y = [toxicity.terms(t, 30).astype(np.int64) for t in texts], np.array(y)
    m = toxicity.fit(rows[:3000], y[:3000], (1500, 1500))
    assert np.mean([(m.score(t) >= 0.5) == v for t, v in zip(texts[3000:], y[3000:])]) > 0.95


def test_pair_terms_in_blocks():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2, (900, 40))
    y = (x[:, 3] == x[:, 33]).astype(float)
    rows = [np.flatnonzero(r) * 10 for r in x]
    assert toxicity.pair_terms(rows, y, 4096).tolist() == toxicity.pair_terms(rows, y, 4096, block=7).tolist() == [30, 330]
    assert not len(toxicity.pair_terms(rows, rng.integers(0, 2, 900).astype(float), 4096))


def test_repeated_ids_reach_the_driver_once(spark):
    docs = spark.range(10_000).selectExpr("CAST(1 AS long) AS doc_id", "concat('text ', id % 3) AS text").union(spark.sql("SELECT 2L, 'other'"))
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int")
    f = lambda t: np.array([len(t), ord(t[-1])], dtype=np.int32)
    a, b = labelled.collect_features(docs, sample, f), labelled.collect_features(docs.repartition(5), sample, f)
    assert len(a[0]) == 2 and sorted(a[1]) == [0, 1] and [x.tolist() for x in a[0]] == [x.tolist() for x in b[0]]


def test_shapes():
    assert [quality._shape(w) for w in ("the", "A", "THE", "The", "THE!!", "a1b22", "the&&&", "|", "It's")] == ["a+", "A", "A+", "Aa+", "A+!+", "a0a0+", "a+&+", "|", "Aa'a"]


@pytest.mark.parametrize("module,label,score", [(quality, "quality", quality.score_quality), (toxicity, "toxic", toxicity.score_toxicity)])
def test_held_out_accuracy(spark, module, label, score):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    truth = {r.doc_id: r[label] for r in labels.collect() if got[r.doc_id].held_out}
    right = np.mean([got[i].predicted == t for i, t in truth.items()])
    assert right >= 0.97
    one, zero = ([got[i].score for i, t in truth.items() if t == v] for v in (1, 0))
    assert np.mean([a > b for a in one for b in zero]) > 0.9


@pytest.mark.parametrize("label,score", [("quality", quality.score_quality), ("toxic", toxicity.score_toxicity)])
def test_labels_of_held_out_rows_are_not_read(spark, documents, labels, label, score):
    flipped = labels.selectExpr("doc_id", *[f"if(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")])
    a, b = ({r.doc_id: r.score for r in score(documents, x).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("label,score", [("quality", quality.score_quality), ("toxic", toxicity.score_toxicity)])
def test_edges(spark, edge_docs, empty_docs, label, score):
    one = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    rows = score(edge_docs, one).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 2}) == 1
    none = score(edge_docs, one.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    same = score(edge_docs, one.where(f"{label} = 1")).collect()
    assert len({r.score for r in same}) == 1 and same[0].score > 0.9
    assert score(empty_docs, one).count() == 0 and score(empty_docs, one.limit(0)).count() == 0


def test_collect_features_ignores_partitioning(documents, labels):
    sample = labelled.sampled_labels(labels, "toxic", 5, 20)
    assert sample.groupBy("y").count().where("count > 20").count() == 0
    f = lambda t: np.array([len(t), len(re.findall("a", t))], dtype=np.int32)
    a, b = labelled.collect_features(documents, sample, f), labelled.collect_features(documents.repartition(6), sample, f)
    assert [x.tolist() for x in a[0]] == [x.tolist() for x in b[0]] and a[1].tolist() == b[1].tolist()
