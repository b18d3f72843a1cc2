"""The pruned cosine join against all pairs, and what it prunes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodtext.operators import align as AL

SENT, FEAT = "product_id int, para_ord int, sent_ord int, vec array<double>", "product_id int, feature string, vec array<double>"


def tables(spark, sides):
    """sides: {product: (sentence matrix, feature matrix)}"""
    sents = [(k, i // 10, i % 10, None if v is None else [float(z) for z in v]) for k, (x, _) in sides.items() for i, v in enumerate(x)]
    feats = [(k, f"f{i}", None if v is None else [float(z) for z in v]) for k, (_, y) in sides.items() for i, v in enumerate(y)]
    return spark.createDataFrame(sents, SENT), spark.createDataFrame(feats, FEAT)


def brute(sides, threshold):
    out = {}
    for k, (x, y) in sides.items():
        xs, ys = ([i for i, v in enumerate(m) if v is not None and np.any(v)] for m in (x, y))
        if xs and ys:
            a, b = np.array([x[i] for i in xs]), np.array([y[j] for j in ys])
            sim = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
            out |= {(k, xs[i] // 10, xs[i] % 10, f"f{ys[j]}"): float(sim[i, j]) for i, j in zip(*np.nonzero(sim > threshold))}
    return out


def clustered(rng, n, d, centers, spread):
    c = centers[rng.integers(len(centers), size=n)]
    return c + spread * rng.standard_normal((n, d))


@pytest.fixture(scope="module")
def sides():
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 16))
    return {1: (clustered(rng, 400, 16, centers, 0.2), clustered(rng, 300, 16, centers, 0.2)), 2: (rng.standard_normal((150, 16)), rng.standard_normal((90, 16))),
            3: (rng.standard_normal((5, 16)), rng.standard_normal((3, 16))), 4: (np.ones((100, 16)), np.ones((70, 16))), 5: ([np.zeros(16), None, np.ones(16)], [np.ones(16), np.zeros(16), None]),
            6: (rng.standard_normal((4, 16)), [])}


@pytest.mark.parametrize("threshold", [-0.5, 0.25, 0.999999])
def test_all_pairs(spark, sides, threshold):
    got = {(r.product_id, r.para_ord, r.sent_ord, r.feature): r.sim for r in AL.embedding_pairs(*tables(spark, sides), threshold, block=32).collect()}
    want = brute(sides, threshold)
    edge = {k for k in got.keys() ^ want.keys() if abs({**got, **want}[k] - threshold) > 1e-9}
    assert not edge
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())


def test_small_products_need_no_index(spark, sides):
    got = {(r.product_id, r.para_ord, r.sent_ord, r.feature) for r in AL.embedding_pairs(*tables(spark, sides), 0.25).collect()}
    assert got == set(brute(sides, 0.25))


def test_far_blocks_are_not_compared(spark):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((24, 32))
    x, y = (clustered(rng, 2400, 32, centers, 0.15) for _ in range(2))
    join = AL.DensePairs(*tables(spark, {7: (x, y)}), 0.5, "product_id", 64)
    blocks = join.blocks()
    n = {r.side: r["count"] for r in blocks.groupBy("side").count().collect()}
    assert join.block_pairs(blocks).count() < 0.5 * n[0] * n[1]
    assert blocks.agg(F.max(F.size("rows"))).first()[0] < 200
    assert join.large().count() == len(brute({7: (x, y)}, 0.5))
