"""Block naming against a dictionary of normalised texts."""

import hashlib
from collections import defaultdict

import pytest

from prodtext.llm.exact_dedup import exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").encode().lower()].append(doc_id)
    out = []
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        out += [(i, top, len(ids), hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [7, 64, 16384])
def test_groups_match_texts(documents, block_bytes):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = exact_duplicates(documents, block_bytes).cache()
    assert found(out) == expected(rows)
    kept = [r for r in out.collect() if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({t for _, t in [(0, (x[1] or "").encode().lower()) for x in rows]})
    assert len({(r.n_blocks, r.name) for r in out.collect()}) == len(kept)  # one identity per text


def test_edges(edge_docs, empty_docs):
    out = exact_duplicates(edge_docs, 1000).collect()
    assert found(exact_duplicates(edge_docs, 1000)) == expected([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})  # of repeated rows one stays
    assert exact_duplicates(empty_docs).count() == 0


def test_texts_that_differ_in_one_block_or_in_length(spark):
    base = "ab" * 500
    texts = [base, base[:-1], base + "a", base[:500] + "x" + base[501:], base, "x" + base[1:], base.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(df, 100).collect()}
    assert got == {0: (6, 3), 4: (6, 3), 6: (6, 3), 1: (1, 1), 2: (2, 1), 3: (3, 1), 5: (5, 1)}
