"""Packing rule by hand, balance, groups, slots and hot groups."""

import zlib

import numpy as np

from prodtext.llm import sharding as S


def test_pack_follows_the_dot_product():
    v = np.array([[4.0, 0.0], [0.0, 4.0], [3.0, 1.0], [1.0, 3.0]])
    total, residual, want = v.sum(axis=0), np.ones((2, 2)), []
    for x in v / (total / 2):
        best = int(np.argmax(residual @ x))
        want.append(best)
        residual[best] -= x
    assert S.pack(v, 2).tolist() == want == [0, 0, 1, 1]


def checks(docs, out, n_shards=8):
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert 0 <= r.shard < n_shards
        by.setdefault(r.shard, []).append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    return rows


def test_documents(documents):
    rows = checks(documents, S.shard_documents(documents))
    texts = {r.doc_id: r.text for r in documents.collect()}
    where, load = {}, {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        where.setdefault(data, set()).add(r.shard)
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together
    assert max(load.values()) <= 1.05 * min(load.values())
    again = {r.doc_id: (r.shard, r.slot) for r in S.shard_documents(documents.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_bundles_and_chunks(documents):
    """Few bundles and small chunks: most groups are bundled, many chunks make one shard."""
    rows = checks(documents, S.shard_documents(documents, bundles=24, chunk_rows=1))
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert len(load) == 8


def test_a_hot_group_is_split(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"own text {i}") for i in range(3000)], "doc_id long, text string")
    rows = checks(docs, S.shard_documents(docs))
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) <= 1.1 * min(load.values())


def test_edges(spark, edge_docs, empty_docs):
    rows = checks(edge_docs, S.shard_documents(edge_docs))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(1, 0)}
    assert S.shard_documents(empty_docs).count() == 0
    same = [r.shard for r in rows if r.text_crc32 == zlib.crc32(b"one two three four five six")]
    assert len(same) == 3 and len(set(same)) == 1


def test_sizes_are_near_equal_with_hot_texts(spark):
    """One text with most of all bytes, and one just below a whole shard."""
    hot = [(i, "h" * 99) for i in range(3000)] + [(10_000 + i, f"own {i}" + "x" * (i % 50)) for i in range(2000)]
    nearly = [(i, "h" * 99) for i in range(500)] + [(10_000 + i, f"{i} " + "x" * (i % 90)) for i in range(6200)]
    for rows in (hot, nearly):
        load = {}
        for r in checks(docs := spark.createDataFrame(rows, "doc_id long, text string"), S.shard_documents(docs)):
            load[r.shard] = load.get(r.shard, 0) + r["size"]
        assert len(load) == 8 and max(load.values()) <= 1.02 * min(load.values())
