"""T-occurrence search against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from prodtext.llm import jaccard as J

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(rows):
    """Sorted (doc_id, n_shingles, component_id, n_links)."""
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                links[a], links[b] = links[a] + 1, links[b] + 1
                parent[top(a)] = top(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted([(d, len(s), least.get(top(i)), n) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))], key=str)


def joined(docs, **options):
    return sorted((tuple(r) for r in J.jaccard_join(docs, **options).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("cell", [J.CELL, 150])
def test_documents(documents, cell):
    assert joined(documents, cell=cell) == plain([(r.doc_id, r.text) for r in documents.collect()])


def near_copies(rng, n, words, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        mine = list(base)
        for _ in range(rng.randrange(changes + 1)):
            mine[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("cell", [J.CELL, 2000])
def test_planted_groups(spark, cell):
    """Groups of near copies around the threshold, chains, a common passage in many texts, and copies;
    the small cell deals the large groups into many tasks."""
    rng = random.Random(8)
    texts = near_copies(rng, 120, 80, 4) + near_copies(rng, 60, 30, 1) + near_copies(rng, 40, 300, 12)
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(rng.randrange(3, 14)))}" for _ in range(80)]
    chain = [f"c{i}" for i in range(60)]
    for step in range(20):
        chain = [*chain[2:], f"d{step}", f"e{step}"]
        texts.append(" ".join(chain))
    texts += [texts[3]] * 30 + [texts[3].upper()] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, SCHEMA).repartition(5), cell=cell) == plain(rows)


def test_flushes_and_buckets(spark, documents, monkeypatch):
    """Many small flushes and buckets give the same rows."""
    monkeypatch.setattr(J, "FLUSH", 500)
    monkeypatch.setattr(J, "BUCKET", 2000)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert joined(documents) == plain(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_divide_skip_finds_all_partners(percent):
    rng = random.Random(percent)
    sets = []
    for _ in range(40):
        base = rng.sample(range(400), rng.randrange(3, 60))
        sets += [sorted(set(rng.sample(base, max(1, len(base) - rng.randrange(6)))) | set(rng.sample(range(400), rng.randrange(4)))) for _ in range(5)]
    sides = np.array([rng.choice([0, 1, 2]) for _ in sets])
    sizes = np.array([len(s) for s in sets])
    got = {(i, j) for i, found in J.divide_skip([np.array(s) for s in sets], sizes, percent, sides) for j in found.tolist()}
    want = {(i, j) for j, i in itertools.combinations(range(len(sets)), 2)
            if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j])) and (sides[i] != sides[j] or sides[j] == 2)}
    assert {p for p in want if sides[p[1]] == 2 or sides[p[1]] != sides[p[0]]} == got


def test_edges(edge_docs, empty_docs):
    assert joined(edge_docs) == plain([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert joined(empty_docs) == []


def test_long_texts_in_slices(monkeypatch):
    text = ("alpha beta  gamma\tDelta " * 50 + "epsilon zeta " + "w" * 3000 + " x y z").encode()
    whole = J.Shingler(5).of(text)
    assert len(whole) == len(shingles(text.decode()))
    monkeypatch.setattr("prodtext.llm.simhash.SLICE", 97)
    monkeypatch.setattr(J, "WORDS_HELD", 3)
    assert (J.Shingler(5).of(text) == whole).all()
