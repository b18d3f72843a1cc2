"""Fingerprints bit by bit, links and components against all pairs."""

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from prodtext.llm import simhash as S


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = S.near_duplicates(documents).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.fp % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)
    assert [r.doc_id == r.component_id for r in got] == [r.kept for r in got]


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains, dense balls and far points; also a large group at one anchor."""
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(6):  # a chain of steps of 3 bits
            for b in rng.sample(range(64), 3):
                x ^= 1 << b
            prints.append(x)
    center = rng.getrandbits(64)
    prints += [center ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(32, 64), 2)]  # 496 in one half
    prints += [rng.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1, 7, 1 << 63]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp long")
    members = S._anchor_rows(nodes).repartition("anchor").sortWithinPartitions("anchor", "fp")
    roots = S.components(members.mapInArrow(S._stars(3), "a long, b long"), 1000)
    got = {r.node % 2**64: r.root % 2**64 for r in roots.collect()}
    want = brute_components(dict(enumerate(prints)))
    groups = lambda m: sorted(sorted(g) for g in m if len(g) > 1)
    by_root, by_want = {}, {}
    for x in prints:
        by_root.setdefault(got.get(x, x), []).append(x)
    for i, r in want.items():
        by_want.setdefault(r, []).append(prints[i])
    assert groups(by_root.values()) == groups(by_want.values())


def test_every_pair_within_one_bit_of_a_half_meets(spark):
    """Covering: x at home meets each y that differs in up to one bit of the half."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    pairs = [(x, x ^ (1 << rng.randrange(64))) for x in base] + [(x, x) for x in base[:5]]
    flat = sorted({p for pair in pairs for p in pair})
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in flat], "fp long")
    at = {}
    for r in S._anchor_rows(nodes).collect():
        at.setdefault(r.fp % 2**64, {})[r.anchor] = r.home
    for x in flat:
        assert len(at[x]) <= 34 and sum(at[x].values()) == 2
    for x, y in pairs:
        assert any(home and a in at[y] for a, home in at[x].items())


def test_edges(edge_docs, empty_docs):
    got = S.near_duplicates(edge_docs).collect()
    for r in got:
        if r.doc_id in (3, 4, 5):
            assert r.fp == 0 and r.component_id == 3
    assert sum(r.kept for r in got) == len({r.component_id for r in got})
    assert S.near_duplicates(empty_docs).count() == 0


def test_long_texts_in_slices(monkeypatch):
    text = ("alpha beta  gamma\tdelta " * 5000 + "w" * 3000).encode()
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "SLICE", 997)
    assert S.fingerprint(text) == whole
    assert S.fingerprint(b"") == 0 and S.fingerprint(b"one two") == plain_fingerprint("one two")
    assert np.uint64(whole).bit_count() > 0


def test_rerun_agrees(documents):
    a, b = (S.near_duplicates(documents).select("doc_id", "fp", "component_id").orderBy("doc_id").collect() for _ in range(2))
    assert a == b and documents.select(F.count("*")).first()[0] == len(a)
