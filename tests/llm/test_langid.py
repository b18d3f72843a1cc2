"""Kneser-Ney probabilities against a dictionary version, held-out accuracy, edges."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prodtext.llm import langid as L
from prodtext.llm.common import crc_mod


def py_model(texts):
    """Interpolated Kneser-Ney of order 4 over the folded texts, by dictionaries."""
    counts = [None] * 5
    counts[4] = Counter(tuple(c[i:i + 4].tolist()) for t in texts for c in [L.letters(t)] if len(c) >= 4 for i in range(len(c) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def py_prob(models, lang, gram, vocabulary):
    counts, k = models[lang], len(gram)
    if k == 0:
        return 1 / (vocabulary + 1)
    ones, twos = (sum(1 for n in counts[k].values() if n == x) for x in (1, 2))
    d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
    same = [n for g, n in counts[k].items() if g[:-1] == gram[:-1]]
    lower = py_prob(models, lang, gram[1:], vocabulary)
    if not same:
        return lower
    return max(counts[k].get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * lower


def test_probabilities(spark):
    texts = {"x": ["The cat sat on the mat, the hat.", "A cat!"], "y": ["Der Hund und die Katze", "ÄÖÜ und der Hut"]}
    docs = spark.createDataFrame([(i, k, t) for k, v in texts.items() for i, t in enumerate(v)], "doc_id long, lang string, text string")
    model = L.fit(docs, F.lit(True), reject=0.0)
    assert model.langs == ["x", "y"]
    models = {k: py_model(v) for k, v in texts.items()}
    vocabulary = len({g for m in models.values() for g in m[1]})
    asked = ["the cat", "und die", "qqq zzz", "Hut the", "Ka"]
    for slice_bytes in (L.SLICE_BYTES, 400):  # one slice and several
        rows = L.entropies(spark.createDataFrame([(t, t) for t in asked], "name string, text string"), model, "name", slice_bytes).collect()
        got = {r.name: r for r in rows}
        assert sorted(got) == sorted(asked) and len(rows) == len(asked)
        for text in asked:
            codes = L.letters(text)
            want = [np.mean([-np.log(py_prob(models, k, tuple(codes[i:i + 4].tolist()), vocabulary)) for i in range(len(codes) - 3)]) for k in ("x", "y")]
            assert got[text].n == len(codes) - 3 and got[text].entropy == pytest.approx(want, abs=1e-4)


def test_probabilities_sum_to_one(spark):
    """After a context, over all characters and the one share of unknown ones."""
    model = L.learn(spark.createDataFrame([("x", "abab bac caab"), ("y", "ab cd")], "lang string, text string"))
    chars = [32] + [ord(c) for c in "abcd"]
    for context in ("ab ", "bac", "cd "):
        first = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        grams = spark.createDataFrame([(first | c,) for c in [*chars, ord("z")]], "gram long")
        p = np.exp(np.array([r.logp for r in L.log_probabilities(grams, model).collect()]))
        assert p.sum(axis=0) == pytest.approx([1, 1], abs=1e-5)


def test_every_gram_is_kept(spark):
    """The model grows with its texts, whatever the number of languages."""
    texts = [(f"l{i:03d}", "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(30))) for i in range(60)]
    model = L.learn(spark.createDataFrame(texts, "lang string, text string"))
    want = [set() for _ in range(4)]
    for _, t in texts:
        for g in L.grams(L.letters(t)).tolist():
            for n in range(1, 5):
                want[n - 1].add(g % 2**(16 * n))
    assert len(model.langs) == 60 and [t.count() for t, _ in model.tables] == [len(w) for w in want]


def test_slices_give_the_same(spark, documents):
    docs = documents.select("doc_id", "lang", "text").limit(150)
    docs = docs.union(docs.limit(20)).union(docs.selectExpr("CAST(NULL AS long)", "lang", "text").limit(5))
    model = L.fit(docs, F.lit(True))
    one, many = ([tuple(r)[:2] + (round(r.score, 9), r.rejected) for r in L.identify(docs, model, b).collect()] for b in (L.SLICE_BYTES, 1 << 17))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert len(one) == docs.count() and sorted(one, key=key) == sorted(many, key=key)


def test_counts_match(spark, documents):
    train = documents.select(F.col("lang"), "text").repartition(5)
    got = defaultdict(Counter)
    for r in L._gram_counts(train).groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        got[r.lang][r.gram % 2**64] = r.n
    want = defaultdict(Counter)
    for r in train.collect():
        want[r.lang].update(L.grams(L.letters(r.text)).tolist())
    assert got == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    rows = L.identify(docs, L.fit(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert 0 < sum(r.rejected for r in rows) < 0.1 * len(rows)


def test_hash_array():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    table = L.HashArray(keys)
    assert (table.keys[table.find(keys)] == keys).all()
    assert (L.HashArray(keys[:0]).find(keys) == -1).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_long_text_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    for text in ("Das ist  ein Satz. " * 20, "a", "  ,, ", "", ",,ab,,", "x y z" * 5, "Ünï😀code" * 3):
        got = list(L.pieces(text))
        assert (np.concatenate(got) if got else np.empty(0)).tolist() == L.grams(L.letters(text)).tolist()


def test_edges(spark, edge_docs, empty_docs):
    model = L.fit(edge_docs, F.lit(True))
    rows = L.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 10)} == {"und"} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} - {"und"} <= {"en", "fr", "xx"}
    nothing = L.fit(empty_docs, F.lit(True))
    assert {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}
    assert L.identify(empty_docs, model).count() == 0


def test_rejection_limits_come_from_all_training_texts(spark):
    """Far more texts of a language than any sample: each odd one counts."""
    common, odd = "the cat sat on the mat", "qzx vkj wq"
    docs = spark.createDataFrame([(i, "x", odd if i % 10 == 0 else common) for i in range(2000)], "doc_id long, lang string, text string")
    train = F.lit(True)
    strict, whole = L.fit(docs, train, reject=0.1), L.fit(docs, train, reject=0.0999)
    entropy = {r.text: r.entropy[0] for r in L.entropies(docs.select("text", F.col("text").alias("t")).limit(20).select("t", "text").withColumnRenamed("t", "name").distinct(), strict, "name").withColumnRenamed("name", "text").collect()}
    assert entropy[common] <= strict.limit[0] < entropy[odd] <= whole.limit[0] <= entropy[odd] + 1 / L.STEPS
    rows = spark.createDataFrame([("a", x / 7) for x in range(1000)] + [("b", 2.5)], "lang string, own double")
    got = dict(L.limits(rows, 0.01).collect())
    assert got["b"] == 2.5 and 989 / 7 <= got["a"] <= 989 / 7 + 1 / L.STEPS
    assert 999 / 7 <= dict(L.limits(rows, 0.0).collect())["a"] <= 999 / 7 + 1 / L.STEPS
