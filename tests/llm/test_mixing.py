"""Targets against plain refilling, Sainte-Lague against one seat at a time, shares and slices."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from prodtext.llm import mixing as M


def refill(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Share by weight, cut off at the cap, share the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed, target = share * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        target = fixed | {s: rest * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            return target
        fixed |= {s: float(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 3, 50, 1000, 40000]) for s in [None, "", "B", "a", "é", "😀", "zz", "x1", "x10", "x2"]}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    assert got == pytest.approx(refill(sizes))


@pytest.mark.parametrize("seed", range(3))
def test_sainte_lague(spark, seed):
    rng = random.Random(seed)
    rows = [(g, p, rng.choice([0, 1, 2, 7, 7, 100, 1000]), rng.randint(0, 60)) for g in range(4) for p in range(rng.randint(1, 9))]
    seats = {g: sum(min(c, 40) for h, _, w, c in rows if h == g and w) // 2 for g in range(4)}
    df = spark.createDataFrame([(*r, seats[r[0]]) for r in rows], "g int, p int, w long, cap long, seats long")
    got = {(r.g, r.p): r.quota for r in M.sainte_lague(df, ["g"], ["p"], "w", "seats", "cap").collect()}
    for g in range(4):
        parties = [(p, w, c) for h, p, w, c in rows if h == g]
        uncapped = spark.createDataFrame([(g, p, w, 10**6, 37) for p, w, _ in parties], "g int, p int, w long, cap long, seats long")
        free = {r.p: r.quota for r in M.sainte_lague(uncapped, ["g"], ["p"], "w", "seats", "cap").collect()}
        quota = {p: 0 for p, _, _ in parties}
        if any(w for _, w, _ in parties):
            for _ in range(37):
                quota[max(parties, key=lambda x: (x[1] / (2 * quota[x[0]] + 1), -x[0]))[0]] += 1
        assert free == quota  # exactly the highest quotients
        assert all(got[(g, p)] <= c for p, _, c in parties) and sum(got[(g, p)] for p, _, _ in parties) <= seats[g]


def test_mix_of_documents(documents):
    rows = M.mix_sources(documents).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    texts = {r.doc_id: r.text for r in documents.collect()}
    by = {}
    for r in rows:
        assert r["size"] == size(texts[r.doc_id]) and 0 <= r.taken <= 2 * r["size"]
        assert all(0 <= p.start and p.start + p.length <= r["size"] for p in r.pieces) and sum(p.length for p in r.pieces) == r.taken
        by.setdefault(r.source, []).append(r)
    want = refill({s: sum(r["size"] for r in g) for s, g in by.items()})
    for s, g in by.items():
        assert g[0].target == pytest.approx(want[s]) and g[0].source_size == sum(r["size"] for r in g)
        assert abs(sum(r.taken for r in g) - want[s]) <= 32
    again = {r.doc_id: r.taken for r in M.mix_sources(documents.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mixed_texts(documents):
    taken = {r.doc_id: r for r in M.mix_sources(documents).collect()}
    out = M.mixed_documents(documents)
    assert out.columns == documents.columns
    for doc_id, rows in itertools.groupby(sorted(out.collect(), key=lambda r: r.doc_id), key=lambda r: r.doc_id):
        rows, text = list(rows), documents.where(F.col("doc_id") == doc_id).first().text if doc_id % 20 == 0 else None
        assert sum(len(r.text.split()) for r in rows) >= 1
        for r in rows:
            assert r.n_chars == len(r.text) and (text is None or r.text in text)
        assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == taken[doc_id].taken


def test_edges(spark, edge_docs, empty_docs):
    rows = M.mix_sources(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert M.mixed_documents(edge_docs).columns == edge_docs.columns
    assert M.mixed_documents(edge_docs).count() > 0
    assert M.mix_sources(empty_docs).count() == 0 and M.mixed_documents(empty_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in M.mix_sources(nothing).collect()] == [0, 0]


def test_small_sources_reach_their_targets(spark):
    """Fifty sources of seven words beside one of 800, and sources of a word or two."""
    rows = [(i, f"s{i:02}", " ".join("abcdefg")) for i in range(50)] + [(100 + i, "zz", "w " * 80) for i in range(10)] + [(200, "t1", "one"), (201, "t2", "one two"), (202, "t0", "")]
    got = M.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 16 for s in target)
    assert all(taken[s] > 0 for s in taken if s != "t0") and taken["t0"] == 0
    assert abs(sum(taken.values()) - sum(target.values())) <= 16
