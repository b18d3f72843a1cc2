"""Extraction quality: span-overlap matching, set metrics, per-fold counters and rates
(J4, A5-A9, X1, X2, O5, N11).

The span join is a range join by (doc_id, position bucket): gold intervals are listed
under the buckets they cover, predicted endpoints look up one bucket each, so only
nearby pairs meet; the exact predicate is applied after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodtext.functions.constants import KFOLD_K, METRIC_TAGS
from prodtext.functions.text import hash_bucket
from prodtext.session import cut_lineage

BUCKET = 64
COUNTERS = ["correct", "missed_init", "FT_init", "correct2", "perfect", "partial", "missed", "FT",
            "misclassified", "total_t", "total_r", "total_t_set", "total_r_set"]


def tag_rank(c):
    return F.when(F.col(c) == METRIC_TAGS[0], 1).when(F.col(c) == METRIC_TAGS[1], 2)


# ---- O5 ------------------------------------------------------------------------------------
def kfold_assign(df: DataFrame, key: str = "doc_id", k: int = KFOLD_K, seed: int = 42) -> DataFrame:
    """Shuffled k-fold as a seeded hash bucket (no global sort, no driver round trip)."""
    return df.withColumn("fold", F.pmod(hash_bucket(seed, key), F.lit(k)).cast("int"))


# ---- J4 / C10 ------------------------------------------------------------------------------
def span_match(pred: DataFrame, gold: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """For each prediction (doc_id, pred_ord, start, end, label): the first gold span (by
    span_ord) that contains either predicted endpoint (inclusive), with match flags."""
    # a document's gold spans are one row, by bucket, which its predictions meet by document: they are not shuffled again
    g = gold.select("doc_id", "span_ord", F.col("start").alias("g0"), F.col("end").alias("g1"),
                    F.col("label").alias("g_label")).repartition("doc_id")
    g = g.withColumn("b", F.explode(F.sequence(F.floor(F.col("g0") / bucket), F.floor(F.col("g1") / bucket))))
    g = g.groupBy("doc_id", "b").agg(F.collect_list(F.struct("span_ord", "g0", "g1", "g_label")).alias("_g"))
    g = g.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "_g"))).alias("_golds"))
    carry = ["fold"] if "fold" in pred.columns else []
    p = pred.select("doc_id", "pred_ord", F.col("start").alias("p0"), F.col("end").alias("p1"),
                    F.col("label").alias("p_label"), *carry)

    def hit(x):
        return ((x["g0"] <= F.col("p1")) & (F.col("p1") <= x["g1"])) | ((x["g0"] <= F.col("p0")) & (F.col("p0") <= x["g1"]))

    def first(b):
        return F.array_min(F.filter(F.element_at("_golds", b), hit))

    b0, b1 = F.floor(F.col("p0") / bucket), F.floor(F.col("p1") / bucket)
    m = F.least(first(b0), F.when(~b0.eqNullSafe(b1), first(b1)))  # least skips nulls; the smallest span_ord is first
    out = p.join(g.hint("merge"), "doc_id", "left").withColumn("m", m).select(
        "doc_id", "pred_ord", "p0", "p1", "p_label", *carry,
        F.col("m.span_ord").alias("gold_ord"), F.col("m.g0").alias("g0"), F.col("m.g1").alias("g1"),
        F.col("m.g_label").alias("g_label"))
    exact = (F.col("p0") == F.col("g0")) & (F.col("p1") == F.col("g1"))
    return out.select(
        "doc_id", "pred_ord", *carry, F.col("p0").alias("start"), F.col("p1").alias("end"),
        F.col("p_label").alias("label"),
        "gold_ord", F.col("g0").alias("gold_start"), F.col("g1").alias("gold_end"), F.col("g_label").alias("gold_label"),
        F.coalesce(exact, F.lit(False)).alias("exact"),
        F.coalesce(exact & (F.col("p_label") == F.col("g_label")), F.lit(False)).alias("perfect"),
        (F.col("gold_ord").isNotNull() & ~F.coalesce(exact, F.lit(False))).alias("partial"),
        F.coalesce(F.col("p_label") != F.col("g_label"), F.lit(False)).alias("misclassified"))


# ---- X2 ------------------------------------------------------------------------------------
def missed_spans(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold spans of tag t whose (start, end) was not hit by predictions of tags up to t
    (the hit list is shared across tags in tag order)."""
    hits = matches.where(F.col("gold_ord").isNotNull()).select(
        "doc_id", F.col("gold_start").alias("start"), F.col("gold_end").alias("end"),
        tag_rank("label").alias("hit_rank")).where(F.col("hit_rank").isNotNull())
    hits = hits.groupBy("doc_id", "start", "end").agg(F.min("hit_rank").alias("hit_rank"))
    carry = ["fold"] if "fold" in gold.columns else []
    g = gold.select("doc_id", *carry, "start", "end", "label", tag_rank("label").alias("rank")).distinct()
    j = g.join(hits, ["doc_id", "start", "end"], "left")
    return j.where(F.col("hit_rank").isNull() | (F.col("hit_rank") > F.col("rank"))).select(
        "doc_id", *carry, "start", "end", "label")


# ---- A6 ------------------------------------------------------------------------------------
def span_metrics(matches: DataFrame, gold: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, tag) -> correct2, perfect, partial, FT, misclassified, missed, total_t, total_r."""
    def with_fold(df):
        return df if "fold" in df.columns else df.join(folds, "doc_id")
    # matches feed the counters and the missed spans: counted by document and gold span where they lie, and written once
    carry = [c for c in ("fold",) if c in matches.columns]
    flags = ["exact", "perfect", "partial", "misclassified"]
    matches = cut_lineage(matches.groupBy("doc_id", *carry, "label", "gold_ord", "gold_start", "gold_end", *flags).agg(F.count(F.lit(1)).alias("n")))
    m = with_fold(matches).where(F.col("label").isin(*METRIC_TAGS))
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0)))
    pm = m.groupBy("fold", F.col("label").alias("tag")).agg(
        of("exact").alias("correct2"), of("perfect").alias("perfect"),
        of("partial").alias("partial"), of("misclassified").alias("misclassified"),
        F.sum("n").alias("total_t"))
    gm = with_fold(gold).groupBy("fold", F.col("label").alias("tag")).agg(
        F.count(F.lit(1)).alias("total_r"))
    ms = with_fold(missed_spans(matches, gold)).groupBy("fold", F.col("label").alias("tag")).agg(
        F.count(F.lit(1)).alias("missed"))
    return pm.join(gm, ["fold", "tag"], "full").join(ms, ["fold", "tag"], "full")


# ---- A5 / X1 / C11 -------------------------------------------------------------------------
def entity_set_metrics(gold_surfaces: DataFrame, pred_surfaces: DataFrame, folds: DataFrame) -> DataFrame:
    """Lower-cased distinct surfaces per document; PROD only for documents with gold PROD.
    Inputs: (doc_id, label, surface).  Each input is read once: the PROD rule is a
    per-document flag computed after the full outer join."""
    carried = "fold" in gold_surfaces.columns and "fold" in pred_surfaces.columns
    fc = ["fold"] if carried else []
    r = gold_surfaces.select("doc_id", *fc, "label", F.lower("surface").alias("s")).distinct().withColumn("in_r", F.lit(True))
    t = pred_surfaces.select("doc_id", *fc, "label", F.lower("surface").alias("s")).distinct().withColumn("in_t", F.lit(True))
    j = r.join(t, ["doc_id", *fc, "label", "s"], "full")
    in_r, in_t = F.coalesce("in_r", F.lit(False)), F.coalesce("in_t", F.lit(False))
    has_prod = F.max((in_r & (F.col("label") == METRIC_TAGS[1])).cast("int")).over(Window.partitionBy("doc_id"))
    j = j.withColumn("doc_has_prod", has_prod).where((F.col("label") != METRIC_TAGS[1]) | (F.col("doc_has_prod") == 1))
    if not carried:
        j = j.join(folds, "doc_id")
    return j.groupBy("fold", F.col("label").alias("tag")).agg(
        F.count_if(in_r & in_t).alias("correct"), F.count_if(in_r & ~in_t).alias("missed_init"),
        F.count_if(in_t & ~in_r).alias("FT_init"), F.count_if(in_t).alias("total_t_set"),
        F.count_if(in_r).alias("total_r_set"))


def fold_metrics(set_m: DataFrame, span_m: DataFrame, folds: DataFrame) -> DataFrame:
    """One row per (fold, tag) for every fold present, all counters as bigint (0 if absent)."""
    grid = folds.select("fold").distinct().select("fold", F.explode(F.array(*[F.lit(t) for t in METRIC_TAGS])).alias("tag"))
    j = grid.join(set_m, ["fold", "tag"], "left").join(span_m, ["fold", "tag"], "left")
    out = j.select("fold", "tag", *[(F.lit(0) if c == "FT" else F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c)
                                    for c in COUNTERS])
    return out.withColumn("FT", F.col("total_t") - F.col("correct2") - F.col("partial"))


# ---- A7 / A8 -------------------------------------------------------------------------------
def fold_rates(m: DataFrame) -> DataFrame:
    def d(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    r = m.select(
        "fold", "tag",
        d("correct", "total_t_set").alias("correct"), d("FT_init", "total_t_set").alias("FT_init"),
        d("missed_init", "total_r_set").alias("missed_init"),
        d("correct2", "total_t").alias("correct2"), d("partial", "total_t").alias("partial"),
        d("perfect", "total_t").alias("perfect"), d("FT", "total_t").alias("FT"),
        d("misclassified", "total_t").alias("misclassified"), d("missed", "total_r").alias("missed"),
        *[F.col(c).cast("double").alias(c) for c in ("total_t", "total_r", "total_t_set", "total_r_set")])
    return (r.withColumn("correct_plus_partial", F.col("correct") + F.col("partial"))
             .withColumn("correct2_plus_partial", F.col("correct2") + F.col("partial")))


RATE_COLS = ["correct", "missed_init", "FT_init", "correct2", "perfect", "partial", "missed", "FT",
             "misclassified", "total_t", "total_r", "total_t_set", "total_r_set",
             "correct_plus_partial", "correct2_plus_partial"]


# ---- A9 ------------------------------------------------------------------------------------
def tag_mean_std(rates: DataFrame) -> DataFrame:
    """Long form (tag, metric, mean, std) over folds; nulls skipped; sample std."""
    long = rates.unpivot(["fold", "tag"], RATE_COLS, "metric", "value")
    return long.groupBy("tag", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def round_cols(df: DataFrame, cols, nd: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), nd).alias(c) if c in cols else F.col(c) for c in df.columns])
