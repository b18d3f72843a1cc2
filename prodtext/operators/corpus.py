"""Corpus building: dedupe, seeded order/split, record round trip, sequence packing
(A1, A2, A13, O3, O4, N9, N10, S6, S7)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodtext.functions import constants as K
from prodtext.functions.text import WS, hash_bucket, replace_all, word_array


def _survivor(value, key) -> Column:
    """Names a row's value and key in one string, null by itself, so that it joins like any key."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))
    return F.concat(part(value), F.lit(":"), part(key))


def _kept(df: DataFrame, key: str, by: str, first) -> DataFrame:
    """One row per distinct ``by`` value: that of the key with the smallest ``first``; rows that repeat
    value and key are one.  Values are grouped by their sha-256 digest (null by itself), so the
    aggregate carries fixed-size keys and partial minima; texts join by digest and key only."""
    digest = F.sha2(by, 256)
    best = df.groupBy(digest.alias("_d")).agg(F.min(F.struct(first.alias("first"), F.col(key).alias("k"))).alias("_m"))
    best = best.select(_survivor(F.col("_d"), F.col("_m.k")).alias("_s"))
    return df.withColumn("_s", _survivor(digest, F.col(key))).join(best, "_s", "left_semi").dropDuplicates(["_s"]).drop("_s")


# ---- A1 ------------------------------------------------------------------------------------
def dedupe_descriptions(df: DataFrame, key: str = "doc_id", by: str = "description", seed: int = 42) -> DataFrame:
    """One survivor per distinct ``by`` value: the row with the smallest seeded hash of ``key``.
    A null value is a value; a null key is a key; repeated rows are one."""
    return _kept(df, key, by, hash_bucket(seed, key))


# ---- A2 ------------------------------------------------------------------------------------
def dedupe_ordered(df: DataFrame, by: str = "text", order: str = "doc_id") -> DataFrame:
    """Ordered distinct: keep the first occurrence (smallest ``order``, null last) of each value."""
    return _kept(df.select(order, by), order, by, F.col(order).isNull())


# ---- O3 ------------------------------------------------------------------------------------
def seeded_order(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Reproducible shuffle: a seeded hash sort key (order by it where order is observable)."""
    return df.withColumn("shuffle_key", hash_bucket(seed, key))


# ---- O4 ------------------------------------------------------------------------------------
def split_train_valid_test(df: DataFrame, key: str = "doc_id", seed: int = K.SPLIT_SEED,
                           train: float = K.TRAIN_FRACTION, valid_of_rest: float = K.VALID_FRACTION_OF_REST) -> DataFrame:
    """90 % train, then 80 % of the rest valid, the remainder test, by a seeded hash bucket
    (per-row, no sort, stable when rows are added)."""
    b = F.pmod(hash_bucket(seed, key), F.lit(10000))
    t_cut = int(round(train * 10000))
    v_cut = t_cut + int(round((10000 - t_cut) * valid_of_rest))
    return df.withColumn("split", F.when(b < t_cut, "train").when(b < v_cut, "valid").otherwise("test"))


# ---- O3 / O4 / O5, exact sizes ------------------------------------------------------------
def rank_cuts(df: DataFrame, ranks: Sequence[int], key: str = "doc_id", seed: int = 42, widths: Sequence[int] = (11, 11, 10)) -> list[tuple[int, object] | None]:
    """For each rank r the place (hash, key) before which r rows lie in the order of the seeded 32-bit hash and
    the key (null first); None where r is not below the number of rows.

    No sort: the hash's bits are counted in ``widths`` passes, each inside the buckets that the pass
    before found, so a pass brings 2^width counts for each rank to the driver; keys that share
    the hash at a cut (few: it has 32 bits) are counted last."""
    h, ranks = hash_bucket(seed, key), list(ranks)
    rows = df.select(h.alias("h"), F.col(key).alias("k"))
    prefix, left, known = [0] * len(ranks), list(ranks), 0  # the cut's first ``known`` bits, and the rows still to pass
    for width in widths:
        known += width
        place = F.shiftright("h", 32 - known)
        wanted = sorted({p for p in prefix if p is not None})
        inside = rows.where(F.shiftright(place, width).isin(wanted)) if known > width else rows
        counts: dict[int, dict[int, int]] = {}
        for r in inside.groupBy(place.alias("place")).count().collect():
            counts.setdefault(r["place"] >> width, {})[r["place"]] = r["count"]
        for i, p in enumerate(prefix):
            if p is None:
                continue
            prefix[i] = None
            for place_no in sorted(counts.get(p, {})):
                if left[i] < counts[p][place_no]:
                    prefix[i] = place_no
                    break
                left[i] -= counts[p][place_no]
    tied: dict[int, list] = {}
    for r in rows.where(F.col("h").isin(sorted({p for p in prefix if p is not None}))).groupBy("h", "k").count().collect():
        tied.setdefault(r["h"], []).append((r["k"], r["count"]))
    out: list[tuple[int, object] | None] = []
    for p, n in zip(prefix, left):
        cut = None
        for k, count in sorted(tied.get(p, []), key=lambda x: (x[0] is not None, x[0])):
            if n < count:
                cut = (p, k)  # rows of one key stay together: the cut is before them all
                break
            n -= count
        out.append(cut)
    return out


def _passed(cuts: list[tuple[int, object] | None], key: str, seed: int) -> Column:
    """How many of the cuts a row lies behind (a null key is before all others)."""
    h, k = hash_bucket(seed, key), F.col(key)
    total = F.lit(0)
    for cut in cuts:
        if cut is not None:
            tie = F.lit(True) if cut[1] is None else F.coalesce(k >= F.lit(cut[1]), F.lit(False))
            total = total + ((h > cut[0]) | ((h == cut[0]) & tie)).cast("int")
    return total


def split_exact(df: DataFrame, key: str = "doc_id", seed: int = K.SPLIT_SEED, train: float = K.TRAIN_FRACTION,
                valid_of_rest: float = K.VALID_FRACTION_OF_REST) -> DataFrame:
    """floor(90 %) train, floor(80 % of the rest) valid, the remainder test, in seeded hash order.  Sizes are
    exact for distinct keys; rows of a repeated key stay in one part."""
    n = df.count()
    n_train = math.floor(n * train + 1e-9)
    n_valid = math.floor((n - n_train) * valid_of_rest + 1e-9)
    behind = _passed(rank_cuts(df, [n_train, n_train + n_valid], key, seed), key, seed)
    return df.withColumn("split", F.when(behind == 0, "train").when(behind == 1, "valid").otherwise("test"))


def kfold_exact(df: DataFrame, key: str = "doc_id", k: int = K.KFOLD_K, seed: int = 42) -> DataFrame:
    """Shuffled k folds whose sizes differ by one row at most (the first n mod k have one more), for distinct keys."""
    n = df.count()
    cuts = [i * (n // k) + min(i, n % k) for i in range(1, k)]
    return df.withColumn("fold", _passed(rank_cuts(df, cuts, key, seed), key, seed))


def sample_exact(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n random rows (all, if there are fewer), the same on every run."""
    return df.where(_passed(rank_cuts(df, [n], key, seed), key, seed) == 0)


# ---- A13 -----------------------------------------------------------------------------------
def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


# ---- S6 / S7 -------------------------------------------------------------------------------
def _not_blank(c: str) -> Column:
    """Whether the text holds anything but whitespace; the search ends there."""
    return F.col(c).rlike(WS.replace("[", "[^", 1))


def read_records(spark, path: str, terminator: str = " " + K.OVERV_END) -> DataFrame:
    """Records separated by ' <OVERV_END>': newlines removed, blank remainders dropped."""
    raw = spark.read.option("lineSep", terminator).text(path)
    rec = raw.select(F.replace("value", F.lit("\n"), F.lit("")).alias("record"))
    return rec.where(_not_blank("record"))


def read_model_inputs(spark, path: str, terminator: str = " " + K.OVERV_END) -> DataFrame:
    """Same split, terminator re-appended (what the model sees)."""
    raw = spark.read.option("lineSep", terminator).text(path)
    return raw.where(_not_blank("value")).select(F.concat("value", F.lit(terminator)).alias("text"))


# ---- N9 / P12 ------------------------------------------------------------------------------
def _between(c: Column, start: str, end: str) -> Column:
    """First non-greedy hit between the markers, null without one; the pattern's '.' stops at a newline
    only, Java's at more line ends.  A text without newlines is cut at the markers by plain search, as a
    lazy pattern tries the end at every character."""
    pattern = f"{start}([^\n]*?){end}"
    rest = F.substr(c, F.instr(c, start) + F.lit(len(start)))
    plain = F.when(F.contains(c, F.lit(start)) & F.contains(rest, F.lit(end)), F.substring_index(rest, end, 1))
    return F.when(F.contains(c, F.lit("\n")), F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))).otherwise(plain)


def parse_training_record(df: DataFrame, col: str = "record") -> DataFrame:
    """record -> originalInput, input, title, Description (first non-greedy hit);
    a part that does not match is null and named in ``reject_reason``."""
    r = F.col(col)
    df = df.select(r.alias("record"), F.substring_index(r, f" {K.DESCR_START}", 1).alias("originalInput"))  # cut once
    r, orig = F.col("record"), F.col("originalInput")
    inp = replace_all(_between(orig, f"{K.FEAT_START} ", f" {K.FEAT_END}"), [(K.NEXT_FEAT, "<br>"), ("br><h2>", ""), ("</li><li>", "")])
    title = _between(orig, f"{K.NAME_START} ", f" {K.NAME_END}")
    desc = _between(r, f"{K.DESCR_START} ", f" {K.DESCR_END}")
    out = df.select(orig, inp.alias("input"), title.alias("title"), desc.alias("Description"))
    reason = F.concat_ws(",", F.when(F.col("input").isNull(), F.lit("no features")),
                         F.when(F.col("title").isNull(), F.lit("no title")),
                         F.when(F.col("Description").isNull(), F.lit("no description")))
    return out.withColumn("reject_reason", F.when(reason != "", reason))


# ---- N10 -----------------------------------------------------------------------------------
def pack_sequences(df: DataFrame, col: str = "text", max_len: int = K.MAX_SEQ_LEN, pad: str = K.PAD,
                   tokens_col: str | None = None) -> DataFrame:
    """Fixed-length token sequences: truncate to max_len, right-pad, attention mask 1/0.
    Tokens are whitespace words unless a caller-supplied token column is given."""
    toks = F.col(tokens_col) if tokens_col else word_array(col)
    t = F.slice(toks, 1, max_len)
    n = F.size(t)
    return df.select("*", F.concat(t, F.array_repeat(F.lit(pad), F.lit(max_len) - n)).alias("tokens"),
                     F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_len) - n)).alias("attention_mask"))
