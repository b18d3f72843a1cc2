"""Review parsing and feature/sentence alignment (T6, T7 via render, R9, J6, W4, W5, W6, T19).

Similarity joins stay inside one product: features of a product come from its
prompts (a bounded list) and are compared with that product's sentences.  For
text, vectors are word counts, a product's features are one row, and dot products
are made where a sentence meets it -- exact for count vectors, and only
pairs that share a word are compared.  Caller-supplied dense vectors are compared block
by block in Arrow batches; blocks of a large product that are too far apart are not.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prodtext.functions.constants import COSINE_THRESHOLD, FEATURE_TEMPLATE
from prodtext.functions.text import WS, replace_all, strip_ws
from prodtext.operators.catalog import shuffled
from prodtext.session import cut_lineage

HEADER = rf"^{WS}*(#|<h2>|<h4>)"
MARKERS = [("#", ""), ("<h2>", ""), ("</h2>", ""), ("<h4>", ""), ("</h4>", "")]


# ---- T6 / W6 / C13 -------------------------------------------------------------------------
def parse_review_paragraphs(reviews: DataFrame, key: str = "product_id", col: str = "review") -> DataFrame:
    """First line dropped; a line starting with #, <h2> or <h4> opens a section (markers
    stripped, trimmed); other non-blank lines join its body with a space.  Whole reviews are dealt out by
    key; what follows by product stays where they are."""
    lines = reviews.select(key, col).repartition(key).select(key, F.posexplode(F.split(F.col(col), "\n")).alias("ln", "line")).where(F.col("ln") > 0)
    is_h = F.col("line").rlike(HEADER)
    w = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("is_h", is_h).withColumn("para_ord", F.sum(F.col("is_h").cast("int")).over(w))
    lines = lines.where(F.col("para_ord") > 0).withColumn("clean", strip_ws(replace_all(F.col("line"), MARKERS)))
    # exactly one header line per section: the first (only) non-null collected value
    g = lines.groupBy(key, "para_ord").agg(
        F.element_at(F.collect_list(F.when(F.col("is_h"), F.col("clean"))), 1).alias("para_title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_h") & (F.col("clean") != ""),
                                                                       F.struct("ln", "clean")))),
                                 lambda x: x["clean"]), " ").alias("para_text"))
    return g.select(key, F.col("para_ord").cast("int").alias("para_ord"), "para_title", "para_text")


def paragraph_sentences(paras: DataFrame, key: str = "product_id") -> DataFrame:
    """Body split on '.', '' removed (decimals are cut, a lone space survives)."""
    return paras.select(key, "para_ord", "para_title",
                        F.posexplode(F.filter(F.split("para_text", r"\."), lambda s: s != "")).alias("sent_ord", "sentence")
                        ).withColumn("sent_ord", (F.col("sent_ord") + 1).cast("int"))


# ---- J6 (dense) ----------------------------------------------------------------------------
MOST_PIVOTS = 128
SLACK = 1e-6  # of an angle: rounding never prunes a pair


def _matrix(rows: pa.ListScalar) -> tuple[pa.StructArray, np.ndarray]:
    """A block's rows and their vectors as a matrix."""
    vec = rows.values.field("vec")
    return rows.values, np.asarray(vec.flatten()).reshape(len(vec), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return np.arccos(np.clip(unit @ (pivots / np.linalg.norm(pivots, axis=1)[:, None]).T, -1, 1))


def _pairs_above(threshold: float, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    sim = np.divide(x @ y.T, norms, out=np.full(norms.shape, -2.0), where=norms > 0)
    i, j = np.nonzero(sim > threshold)
    return i, j, sim[i, j]


def _found(schema: pa.Schema, key, x: tuple, y: tuple, threshold: float) -> pa.RecordBatch:
    """The pairs of two blocks, each (rows, matrix)."""
    (sent, a), (feat, b) = x, y
    i, j, sim = _pairs_above(threshold, a, b)
    take = {**{c: sent.field(c).take(pa.array(i)) for c in ("para_ord", "sent_ord")}, "feature": feat.field("feature").take(pa.array(j))}
    return pa.RecordBatch.from_arrays([pa.array([key] * len(i), schema.field(0).type), take["para_ord"], take["sent_ord"], take["feature"], pa.array(sim)], schema=schema)


class DensePairs:
    """Cosine join of two sets of vectors within a product, with an exact pruning index.

    A product whose sides each fit one block of ``block`` vectors is one pair of blocks.  In a larger one
    vectors are grouped by the nearest of up to MOST_PIVOTS pivots, drawn from both sides by hash, and
    groups are cut into blocks.  A block's label is the interval of its vectors' angles to each pivot.
    Angles obey the triangle inequality, so where the intervals of two blocks lie
    further apart at any pivot than the threshold's angle, none of their pairs can reach it.  Only labels meet
    for that, dealt over tasks by (product, salt); then a sentence block is fetched once,
    and a feature block once for each block that it is compared with."""

    def __init__(self, sent_vecs: DataFrame, feat_vecs: DataFrame, threshold: float, key: str, block: int):
        self.threshold, self.key, self.block = threshold, key, block
        none = F.lit(None)
        ids = ["para_ord", "sent_ord", "feature"]
        types = {**{c: sent_vecs.schema[c].dataType for c in (key, "para_ord", "sent_ord")}, "feature": feat_vecs.schema["feature"].dataType}
        self.out = T.StructType([*[T.StructField(c, types[c]) for c in (key, *ids)], T.StructField("sim", T.DoubleType())])
        s = sent_vecs.select(key, F.lit(0).alias("side"), "para_ord", "sent_ord", none.cast(types["feature"]).alias("feature"), F.col("vec").cast("array<double>").alias("vec"))
        f = feat_vecs.select(key, F.lit(1).alias("side"), none.cast(types["para_ord"]).alias("para_ord"), none.cast(types["sent_ord"]).alias("sent_ord"), "feature", F.col("vec").cast("array<double>").alias("vec"))
        nonzero = F.exists("vec", lambda v: v != 0)  # zero and null vectors match nothing
        self.vecs = s.unionByName(f).where(nonzero & F.col(key).isNotNull()).select("*", F.xxhash64("side", *ids).alias("h"))
        n = self.vecs.groupBy(key).agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
        self.sizes = n.where("n0 > 0 AND n1 > 0").select(key, (F.col("n0") + F.col("n1")).alias("n"), (F.greatest("n0", "n1") > block).alias("large"))
        self.row = F.struct(*ids, "vec")

    def _map(self, df: DataFrame, kernel, fields: list) -> DataFrame:
        schema = fields if isinstance(fields, T.StructType) else T.StructType([T.StructField(self.key, self.out[0].dataType), *[T.StructField(*f) for f in fields]])
        return df.mapInArrow(functools.partial(kernel, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])), schema)

    def small(self) -> DataFrame:
        """Products of one block a side: no index."""
        key, threshold = self.key, self.threshold
        side = lambda n: F.collect_list(F.when(F.col("side") == n, self.row))
        both = (self.vecs.join(self.sizes.where("NOT large").select(key), key).groupBy(key).agg(side(0).alias("sents"), side(1).alias("feats")))

        def run(schema, batches):
            for b in batches:
                for k, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    yield _found(schema, k, _matrix(x), _matrix(y), threshold)

        return self._map(both, run, self.out)

    def blocks(self) -> DataFrame:
        """Blocks of the large products: (key, side, b, rows, lo, hi)."""
        key, block = self.key, self.block
        large = cut_lineage(self.sizes.where("large").withColumn("chunks", F.ceil(F.col("n") / block)))
        vecs = self.vecs.join(large.drop("large"), key)
        n_pivots = F.least(F.lit(MOST_PIVOTS), F.col("chunks")).cast("int")
        drawn = vecs.where(F.pmod("h", F.lit(1 << 30)) < F.lit(4 << 30) * n_pivots / F.col("n"))  # about four times as many as needed
        pivots = cut_lineage(drawn.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "side", "vec"))), 1, F.first(n_pivots)).alias("p"))
                             .select(key, F.transform("p", lambda p: p["vec"]).alias("pivots")))
        chunks = vecs.groupBy(key, "side", F.pmod(F.xxhash64("h"), "chunks").alias("chunk")).agg(F.collect_list(self.row).alias("rows")).join(pivots, key, "left")

        def pivot_matrix(p):
            return np.array(p.as_py()) if p.is_valid else None

        def group(schema, batches):
            for b in batches:
                for k, side, rows, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                    row, x = _matrix(rows)
                    p = pivot_matrix(p)
                    nearest = np.zeros(len(x), np.int32) if p is None else _angles(x, p).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), schema.field(0).type), pa.array([side] * len(x), pa.int32()), pa.array(nearest, pa.int32()),
                                                      *[row.field(c).cast(schema.field(c).type) for c in ("para_ord", "sent_ord", "feature", "vec")]], schema=schema)

        ids = [(f.name, f.dataType) for f in self.out[1:4]]
        members = cut_lineage(self._map(chunks.select(key, "side", "rows", "pivots"), group, [("side", T.IntegerType()), ("group", T.IntegerType()), *ids, ("vec", T.ArrayType(T.DoubleType()))]))
        parts = members.groupBy(key, "side", "group").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        part = F.pmod(F.xxhash64("para_ord", "sent_ord", "feature"), "parts")
        packed = (members.join(parts, [key, "side", "group"]).groupBy(key, "side", F.concat_ws(".", "group", part).alias("b"))
                  .agg(F.collect_list(self.row).alias("rows")).join(pivots, key, "left"))

        def label(schema, batches):
            for b in batches:
                lows, highs = [], []
                for rows, p in zip(b.column("rows"), b.column("pivots")):
                    p = pivot_matrix(p)
                    angles = np.empty((1, 0)) if p is None else _angles(_matrix(rows)[1], p)
                    lows.append(angles.min(axis=0).tolist()), highs.append(angles.max(axis=0).tolist())
                yield pa.RecordBatch.from_arrays([*[b.column(c).cast(schema.field(c).type) for c in (schema.names[0], "side", "b", "rows")],
                                                  *[pa.array(x, schema.field("lo").type) for x in (lows, highs)]], schema=schema)

        angles = T.ArrayType(T.DoubleType())
        return cut_lineage(self._map(packed, label, [("side", T.IntegerType()), ("b", T.StringType()), ("rows", packed.schema["rows"].dataType), ("lo", angles), ("hi", angles)]))

    def block_pairs(self, blocks: DataFrame) -> DataFrame:
        """(key, sb, fb): pairs of blocks whose labels leave room for a pair above the threshold."""
        key, limit = self.key, math.acos(max(-1.0, min(1.0, self.threshold))) + SLACK
        n = blocks.where("side = 0").groupBy(key).agg(F.ceil(F.count(F.lit(1)) / 64).alias("salts"))
        labels = blocks.select(key, "side", "b", "lo", "hi").join(n, key)
        sents = labels.where("side = 0").select(key, F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.col("b").alias("sb"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
        feats = labels.where("side = 1").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("b").alias("fb"), "lo", "hi")
        gap = F.zip_with(F.zip_with("slo", "hi", lambda a, z: a - z), F.zip_with("lo", "shi", lambda a, z: a - z), lambda a, z: F.greatest(a, z))
        return sents.join(feats, [key, "salt"]).where(F.forall(gap, lambda g: g <= limit)).select(key, "sb", "fb")

    def large(self) -> DataFrame:
        key, threshold = self.key, self.threshold
        blocks = self.blocks()
        feats = blocks.where("side = 1").select(key, F.col("b").alias("fb"), "rows")
        fetched = self.block_pairs(blocks).join(feats, [key, "fb"]).select(key, "sb", F.col("fb").alias("b"), F.lit(1).alias("side"), "rows")
        stream = (blocks.where("side = 0").select(key, F.col("b").alias("sb"), F.col("b"), "side", "rows").unionByName(fetched)
                  .repartition(key, "sb").sortWithinPartitions(key, "sb", "side", "b").select(key, "sb", "side", "rows"))

        def run(schema, batches):
            sents = None
            for b in batches:
                for k, side, rows in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    if side == 0:
                        sents = _matrix(rows)
                    else:
                        yield _found(schema, k, sents, _matrix(rows), threshold)

        return self._map(stream, run, self.out)


def embedding_pairs(sent_vecs: DataFrame, feat_vecs: DataFrame, threshold: float = COSINE_THRESHOLD,
                    key: str = "product_id", block: int = 512) -> DataFrame:
    """(product, para, sent, feature, sim) with cosine > threshold, within a product.  Zero and null
    vectors match nothing.  No pair below the threshold ever is a row."""
    join = DensePairs(sent_vecs, feat_vecs, threshold, key, block)
    if join.sizes.where("large").isEmpty():
        return join.small()
    return join.small().unionByName(join.large())


# ---- J6 (word counts) ----------------------------------------------------------------------
def _words(text: str):
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _bound(value, body):
    """``body`` of a value that is made once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counted(words):
    """Distinct words and how often each occurs, from the runs of the sorted words."""
    def runs(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _bound(first, lambda p: F.transform(p, lambda at, k: F.struct(F.get(s, at).alias("token"), (F.coalesce(F.get(p, k + 1), F.size(s)) - at).cast("long").alias("c"))))
    return F.when(F.size(words) > 0, _bound(F.array_sort(words), runs))


def _sum(items, value):
    return F.aggregate(items, F.lit(0).cast("long"), lambda t, x: t + value(x))


def text_pairs(sentences: DataFrame, features: DataFrame, threshold: float = COSINE_THRESHOLD,
               key: str = "product_id", feature_text: str = "feature_sentence", template: str = " ".join(FEATURE_TEMPLATE)) -> DataFrame:
    """Cosine of word-count vectors > threshold; only (feature, sentence) pairs sharing a word meet.

    A product's features are one row, which its sentences meet by product: sentences that lie by product
    are not shuffled, and no word is a row.  A sentence's words are counted once; those that
    no feature says are dropped before its features are gone through.

    The words of ``template`` must be in every feature text (empty: none are).  Their part of the dot product
    depends on the sentence alone: it is made once and added to what else a feature says."""
    sk = [key, "para_ord", "sent_ord"]
    fixed = Counter(re.findall(r"[^\W_]+", template.lower()))

    def times(token):
        n = F.lit(0)
        for word, k in fixed.items():
            n = F.when(token == word, F.lit(k)).otherwise(n)
        return n

    # rows that repeat a key count together, here and in the sentences
    feats = (features.select(key, "feature", _words(feature_text).alias("w")).dropna(subset=[key, "feature"]).repartition(key)
             .groupBy(key, "feature").agg(F.flatten(F.collect_list("w")).alias("w")).select(key, "feature", _counted(F.col("w")).alias("t")).where("t IS NOT NULL"))
    own = F.filter(F.transform("t", lambda x: F.struct(x["token"].alias("token"), (x["c"] - times(x["token"])).alias("c"))), lambda x: x["c"] > 0)
    feats = feats.select(key, F.struct("feature", F.sqrt(_sum(F.col("t"), lambda x: x["c"] * x["c"])).alias("fn"), own.alias("own")).alias("f")).groupBy(key).agg(F.collect_list("f").alias("_feats"))
    feats = feats.withColumn("_said", F.array_distinct(F.flatten(F.transform("_feats", lambda f: F.transform(f["own"], lambda x: x["token"])))))
    sents = sentences.groupBy(*sk).agg(F.flatten(F.collect_list(_words("sentence"))).alias("_w"))

    def sims(x):
        def sim(f):
            dot = _sum(f["own"], lambda o: _sum(x["hits"], lambda h: F.when(h["token"] == o["token"], h["c"] * o["c"]).otherwise(F.lit(0))))
            return F.struct(f["feature"].alias("feature"), _bound(dot, lambda d: F.when((d > 0) | (x["given"] > 0), (d + x["given"]) / (x["sn"] * f["fn"]))).alias("sim"))
        found = F.filter(F.transform("_feats", sim), lambda f: f["sim"] > F.lit(threshold))
        return F.when((F.size(x["hits"]) > 0) | (x["given"] > 0), found)

    def of_words(t):
        return F.struct(F.filter(t, lambda w: F.array_contains("_said", w["token"])).alias("hits"), _sum(t, lambda w: w["c"] * times(w["token"])).alias("given"),
                        F.sqrt(_sum(t, lambda w: w["c"] * w["c"])).alias("sn"))

    found = F.when(F.col("_feats").isNotNull(), _bound(_counted(F.col("_w")), lambda t: _bound(of_words(t), sims)))
    # a left join, as the filter that the planner adds below an inner one would have the texts dealt out a second
    # time; outer, as the one that it adds to the plain explode makes the pairs a second time
    pairs = sents.join(shuffled(feats), key, "left").select(*sk, F.explode_outer(found).alias("p")).where(F.col("p").isNotNull())
    return pairs.select(*sk, F.col("p.feature").alias("feature"), F.col("p.sim").alias("sim"))


# ---- W4 / T19 ------------------------------------------------------------------------------
def align_features(sentences: DataFrame, pairs: DataFrame, key: str = "product_id") -> DataFrame:
    """Each feature at most once per paragraph (earliest sentence); every sentence kept,
    with its sorted matched features (empty when none).  Matches stand beside the sentences as rows
    and meet them in a window, so that sentences which lie by product stay there."""
    ids = [key, "para_ord", "sent_ord"]
    first = pairs.groupBy(key, "para_ord", "feature").agg(F.min("sent_ord").alias("sent_ord"))
    per_sent = first.groupBy(*ids).agg(F.array_sort(F.collect_list("feature")).alias("features")).dropna(subset=ids)
    rest = [c for c in sentences.columns if c not in ids]
    nothing = F.lit(None).cast("array<string>")
    rows = sentences.select(*ids, *rest, nothing.alias("features"), F.lit(True).alias("_sentence"))
    found = per_sent.select(*ids, *[F.lit(None).cast(sentences.schema[c].dataType).alias(c) for c in rest], "features", F.lit(False).alias("_sentence"))
    each = Window.partitionBy(*ids).orderBy("para_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = rows.unionByName(found).withColumn("features", F.first("features", ignorenulls=True).over(each)).where("_sentence").drop("_sentence")
    return both.withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


# ---- W5 ------------------------------------------------------------------------------------
def unmatched_sentences(aligned: DataFrame, key: str = "product_id") -> DataFrame:
    """Running number of sentences without a match, per product in (para, sent) order."""
    w = Window.partitionBy(key).orderBy("para_ord", "sent_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return aligned.withColumn("unmatched_no", F.sum(F.when(F.size("features") == 0, 1).otherwise(0)).over(w))
