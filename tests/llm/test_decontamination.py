"""Index search against plain window matching."""

import re

from pyspark.sql import functions as F

from prodtext.llm import decontamination as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, width):
    out = {}
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            n = min(width, len(b))
            for s in range(max(1, len(b) - width + 1) if b else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == b[s:s + n]:
                        hit.update(range(p, p + n))
                        if item is not None:
                            items.add(str(item))
        out[key] = (len(w), len(hit), sorted(items))
    return out


def found(df, key="doc_id"):
    return {getattr(r, key): (r.n_words, sum(s.stop - s.start for s in r.spans), r["items"]) for r in df.collect()}


BENCH = [(1, "the quick brown fox jumps over the lazy dog and runs away from it all"), (2, "Short item"), (3, "a a a a a a a a a a a a"), (4, None), (5, ""), (6, "!!! ---"),
         (None, "nameless passage of exactly ten words that nobody wrote down"), (7, "short ITEM"), (7, "été 2024 naïve café über straße")]
DOCS = [(1, "He said: the QUICK brown fox jumps over the lazy dog, and runs away!"), (2, "short item short item"), (3, "a " * 25), (4, None), (5, ""),
        (6, "nameless passage of exactly ten words that nobody wrote down."), (7, "the quick brown fox jumps over the dog"), (8, "ÉTÉ 2024 naïve café über straße x été 2024 naïve café über straße"),
        (9, "quick brown fox jumps over the lazy dog and runs quick brown fox jumps over the lazy dog and runs away")]


def test_small_cases(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert found(D.decontaminate(docs, bench)) == brute(DOCS, BENCH, 10)
    # the same in blocks of items
    assert found(D.decontaminate(docs, bench, max_test_words=12)) == brute(DOCS, BENCH, 10)


def test_blocks_are_stretches_of_words(spark):
    """Blocks of whole items, in order, no longer than the bound and one item."""
    bench = spark.createDataFrame(BENCH, "item_id long, text string").repartition(3)
    items, blocks = D._blocks(bench, 12)
    held = {b: [] for b in blocks}
    for r in items.orderBy("i", "t").collect():
        held[r.block].append(len(words(r.t)))
    assert len(blocks) > 2 and sum(map(len, held.values())) == len(set((None if k is None else str(k), t) for k, t in BENCH))
    assert all(sum(n[:-1]) < 12 for n in held.values())


def test_blocks_of_a_repeated_document(spark):
    """Blocks meet by rows, not by doc_id; ids hold although the input's order changes at each reading."""
    docs = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "short item and more")
                                   .when(F.col("id") % 3 == 1, "a " * 25).otherwise("clean text").alias("text")).repartition(5).orderBy(F.rand())
    got = D.decontaminate(docs, spark.createDataFrame(BENCH, "item_id long, text string"), max_test_words=12).collect()
    kinds = sorted((r.n_words, len(r["items"])) for r in got)
    assert kinds == sorted([(4, 2)] * 100 + [(25, 1)] * 100 + [(2, 0)] * 100)


def test_documents(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = documents.where("length(text) < 3000")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert found(D.decontaminate(docs, bench)) == want


def test_segments_do_not_touch(spark):
    """A window may not begin in one document and end in the next."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e", "f g h i j", "a b c d e f g h i j"])], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert {k for k, v in found(D.decontaminate(docs, bench)).items() if v[1]} == {2}


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta x gamma y delta"), (3, "alpha q q q q q q beta gamma delta")], "doc_id long, text string")
    near = {r.doc_id: r.near_items for r in D.decontaminate(docs, bench, slop=2).collect()}
    assert near == {1: ["1"], 2: ["1"], 3: []}


def test_edges(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor"), (2, "four five six")], "item_id long, text string")
    got = [(r.doc_id, r.n_words, len(r.spans)) for r in D.decontaminate(edge_docs, bench).collect()]
    assert len(got) == edge_docs.count()
    assert {d for d, _, n in got if n} == {1, 2, None, 6, 7}
    assert D.decontaminate(empty_docs, bench).count() == 0
    clean = D.decontaminate(edge_docs, bench.where("item_id > 5")).collect()
    assert len(clean) == len(got) and not any(r.spans for r in clean)
