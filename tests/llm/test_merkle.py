"""Manifest against a tree built in plain Python, labels, tampering, edge tables."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from prodtext.llm import merkle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, add=0):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(value(r.doc_id) + value(r.source) + value(r.lang) + value(None if r.n_chars is None else r.n_chars + add) + value(r.text))


def climb(digests):
    """Root, and each leaf's steps: (sibling, is it to the left)."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            other = i ^ 1
            paths[leaf].append((level[other], other < i) if other < len(level) else (None, False))
        level = [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    subroots, out = [], []
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        mine = sorted(trees[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        subroots.append((mine, *climb([plain_leaf(r) for r in mine])))
    root, top = climb([s[1] for s in subroots])
    for (mine, subroot, paths), above in zip(subroots, top):
        for r, path in zip(mine, paths):
            steps = path + above
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            fold = plain_leaf(r, 1 if bad else 0)
            for other, left in steps:
                fold = sha((other + fold if left else fold + other) if other else fold)
            out.append((r.doc_id, plain_leaf(r), subroot, root, sha("".join(s for s, _ in steps if s)), fold, fold == root))
    return sorted(out, key=str)


def manifest(docs, band=8):
    bad = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    checked, bands, top = M.merkle_manifest(docs, presented={"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, band=band)
    return sorted((tuple(r) for r in checked.drop("path").collect()), key=str), bands, top


@pytest.mark.parametrize("band", [2, 8])
def test_documents(documents, band):
    got, bands, top = manifest(documents, band)
    assert got == plain_manifest(documents.collect())
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_labels_are_nested_intervals(documents):
    _, bands, _ = manifest(documents, 3)
    found = {(r["tree"], r["level"], r["lo"]): (r["hi"], r["digest"]) for r in M.nodes(bands, 3).collect()}
    sizes = {}
    for (tree, level, lo), (hi, _) in found.items():
        sizes[tree] = max(sizes.get(tree, 0), hi)
        assert lo < hi
    for tree, n in sizes.items():
        depth = (n - 1).bit_length()
        for level in range(depth + 1):
            mine = sorted((lo, found[t, lv, lo][0]) for t, lv, lo in found if t == tree and lv == level)
            assert [a for a, _ in mine] == [0, *(z for _, z in mine[:-1])] and mine[-1][1] == n  # a level covers all leaves once
        for (t, level, lo), (hi, digest) in found.items():
            if t == tree and level:  # a parent's interval is its children's
                left, right = found[t, level - 1, lo], found.get((t, level - 1, found[t, level - 1, lo][0])) if found[t, level - 1, lo][0] < hi else None
                assert hi == (right or left)[0] and digest == sha(left[1] + (right[1] if right else ""))


def test_edges(edge_docs, empty_docs):
    got, _, _ = manifest(edge_docs, 2)
    assert got == plain_manifest(edge_docs.collect())
    assert manifest(empty_docs)[0] == []


def test_small_trees(spark):
    one = spark.createDataFrame([(1, "x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest(one)[0] == plain_manifest(one.collect())
    langs = spark.createDataFrame([(i, "x", lang, "a", 1) for i, lang in enumerate([None, "", "é", "z", "Z", "a\nb"])], one.schema)
    assert manifest(langs, 2)[0] == plain_manifest(langs.collect())


def test_repeated_rows_of_one_key(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    got, _, _ = manifest(rows)
    assert got == plain_manifest(rows.collect())
