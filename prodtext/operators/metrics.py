"""Generated-text quality: description extraction, truncation, character BLEU/GLEU,
readability indices and per-prompt aggregates (T8, T11-T18, O6, O7, W8, A10-A12, A14, A15).

N-gram statistics are computed as counted rows.  Candidates meet their references as whole texts,
by key; both are exploded to n-grams inside that partitioning, counted and clipped there, so
texts are shuffled and n-grams are not.  A task counts the n-grams of about CHARS_A_TASK characters,
whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodtext.functions import constants as K
from prodtext.functions.text import metric_normalize, sentence_split, syllable_estimate, word_array

# a character makes up to four n-grams, each a row of the hash table that counts them
CHARS_A_TASK = 1 << 18
METRICS = ["bleu", "gleu", "flesch", "coleman", "gunning"]


# ---- O6 / O7 -------------------------------------------------------------------------------
def truncate_words(text, n):
    """First n whitespace words re-joined by single spaces."""
    return F.array_join(F.slice(word_array(text), 1, n), " ")


def truncate_to_ref(df: DataFrame, cand: str = "description", ref: str = "reference", out: str = "text") -> DataFrame:
    return df.withColumn(out, truncate_words(F.col(cand), F.size(word_array(F.col(ref)))))


# ---- W8 ------------------------------------------------------------------------------------
def first_valid_candidate(df: DataFrame, key: str = "prompt_id", order: str = "sample_id") -> DataFrame:
    """First sample (by sample_id) whose description tags parse; hash aggregate, no window."""
    v = df.where(F.col("valid"))
    cols = [c for c in df.columns if c != key]
    return v.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("s")).select(key, "s.*")


# ---- A14 -----------------------------------------------------------------------------------
def char_ngram_counts(df: DataFrame, keys, col: str, max_n: int = 4) -> DataFrame:
    """(keys..., n, gram, cnt) for character n-grams n = 1..max_n."""
    # one array of characters, and grams from neighbours by index: linear in the text
    ch = df.select(*keys, F.split(F.col(col), "").alias("ch")).select(*keys, "ch", F.posexplode("ch").alias("i", "c"))
    grams, gram = [], F.col("c")
    for n in range(1, max_n + 1):
        if n > 1:
            gram = F.concat(gram, F.get("ch", F.col("i") + (n - 1)))  # null behind the end
        grams.append(F.struct(F.lit(n).alias("n"), gram.alias("gram")))
    g = ch.select(*keys, F.explode(F.array(*grams)).alias("x")).select(*keys, "x.n", "x.gram")
    g = g.where(F.length("gram") == F.col("n"))
    return g.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def word_ngram_counts(df: DataFrame, keys, col: str, max_n: int = 4) -> DataFrame:
    """(keys..., n, gram, cnt) for whitespace-word n-grams n = 1..max_n (gram = words joined by ' ')."""
    w = df.select(*keys, word_array(F.col(col)).alias("w"))
    pos = w.select(*keys, "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("i"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.col("i") + n - 1 <= F.size("w"),
                                                           F.array_join(F.slice("w", F.col("i"), n), " ")).alias("gram"))
                      for n in range(1, max_n + 1)])
    g = pos.select(*keys, F.explode(grams).alias("x")).select(*keys, "x.n", "x.gram").where(F.col("gram").isNotNull())
    return g.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"))


def _ngram_total(length_col, n):
    return F.greatest(F.lit(0), length_col - F.lit(n) + 1)


def _tasks(cands: DataFrame, hyp: str) -> int:
    """How many tasks the n-grams are counted in.  The number is given to Spark, as the planner would
    join small partitions of texts to few large ones, whose n-grams spill."""
    chars = cands.agg(F.sum(F.length(hyp).cast("long"))).first()[0] or 0
    least = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(chars / CHARS_A_TASK))


def bleu_gleu(cands: DataFrame, refs: DataFrame, keys=("prompt_id", "sample_id"), ref_key: str = "prompt_id",
              hyp: str = "text", ref: str = "reference", max_n: int = 4, level: str = "char") -> DataFrame:
    """BLEU (uniform weights, brevity penalty, 0 when any precision is 0) and GLEU (pooled
    clipped matches / max(total hyp, total ref)) per candidate.  ``level='char'`` scores
    strings as character sequences (what the source does); ``level='word'`` uses words."""
    keys = list(keys)
    unit_len = (lambda c: F.length(c)) if level == "char" else (lambda c: F.size(word_array(F.col(c))))
    counter = char_ngram_counts if level == "char" else word_ngram_counts
    # rows that repeat a key count together, as do references
    tasks = _tasks(cands, hyp)
    h = cands.select(*keys, hyp).repartition(tasks, ref_key).groupBy(*keys).agg(F.collect_list(hyp).alias("_h"))
    r = refs.select(ref_key, ref).repartition(tasks, ref_key).groupBy(ref_key).agg(F.collect_list(ref).alias("_r"))
    side = lambda c, no: F.transform(c, lambda x: F.struct(F.lit(no).alias("side"), x.alias("t")))
    texts = h.join(r, ref_key).select(*keys, F.explode(F.concat(side("_h", 0), side("_r", 1))).alias("x")).select(*keys, "x.side", "x.t")
    of = lambda no: F.coalesce(F.sum(F.when(F.col("side") == no, F.col("cnt"))), F.lit(0))
    # grouping by more columns than the texts are partitioned by needs no exchange
    both = counter(texts, [*keys, "side"], "t", max_n).groupBy(*keys, "n", "gram").agg(F.least(of(0), of(1)).alias("both"))
    clip = both.groupBy(*keys).agg(*[F.sum(F.when(F.col("n") == n, F.col("both"))).alias(f"m{n}") for n in range(1, max_n + 1)])
    base = cands.select(*keys, unit_len(hyp).alias("c")).join(
        refs.select(ref_key, unit_len(ref).alias("r")), ref_key).join(clip, keys, "left")
    c, rl = F.col("c"), F.col("r")
    logs = None
    all_pos = F.lit(True)
    tp = F.lit(0)
    tpfp = F.lit(0)
    tpfn = F.lit(0)
    for n in range(1, max_n + 1):
        num = F.coalesce(F.col(f"m{n}"), F.lit(0))
        den = F.greatest(F.lit(1), _ngram_total(c, n))
        term = F.log(num / den)
        logs = term if logs is None else logs + term
        all_pos = all_pos & (num > 0)
        tp = tp + num
        tpfp = tpfp + _ngram_total(c, n)
        tpfn = tpfn + _ngram_total(rl, n)
    bp = F.when(c > rl, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.exp(1 - rl / c))
    bleu = F.when(all_pos, bp * F.exp(logs / max_n)).otherwise(F.lit(0.0))
    n_all = F.greatest(tpfp, tpfn)
    gleu = F.when(n_all > 0, tp / n_all).otherwise(F.lit(0.0))
    return base.select(*keys, bleu.alias("bleu"), gleu.cast("double").alias("gleu"))


# ---- T14-T17 / C16 -------------------------------------------------------------------------
def sentence_count(text):
    return F.size(F.filter(sentence_split(text), lambda s: F.regexp_replace(s, r"\s", "") != ""))


def readability(df: DataFrame, text: str = "norm") -> DataFrame:
    """Flesch, Coleman-Liau (source constants) and Gunning Fog (first 100 words); null when
    the text has no words or no sentences."""
    t = F.col(text)
    words = word_array(t)
    w = F.size(words).cast("double")
    s = sentence_count(t).cast("double")
    y = syllable_estimate(t).cast("double")
    a, b, cc = K.FLESCH
    flesch = F.lit(a) - F.lit(b) * F.try_divide(w, s) - F.lit(cc) * F.try_divide(y, w)
    c1, c2, c3 = K.COLEMAN
    coleman = (F.lit(c1) * (F.try_divide(F.length(t).cast("double"), w) * 100)
               - F.lit(c2) * (F.try_divide(s, w) * 100) - F.lit(c3))
    w100 = F.slice(words, 1, K.GUNNING_WORDS)
    n = F.size(w100).cast("double")
    complex_ = F.size(F.filter(w100, lambda x: ~F.substring(x, 1, 1).rlike(r"\p{Lu}") & (syllable_estimate(x) > 2)))
    s100 = sentence_count(F.array_join(w100, " ")).cast("double")
    gunning = F.lit(K.GUNNING) * (F.try_divide(n, s100) + 100 * F.try_divide(complex_.cast("double"), n))
    ok = (w > 0) & (s > 0)
    return df.withColumns({"flesch": F.when(ok, flesch), "coleman": F.when(ok, coleman),
                           "gunning": F.when(ok & (s100 > 0), gunning)})


# ---- A10 / A11 / A12 -----------------------------------------------------------------------
def candidate_mean_std(scores: DataFrame, metrics=METRICS, key: str = "prompt_id") -> DataFrame:
    """Per prompt: mean and sample std of each metric over succeeded samples; the whole row is
    null when fewer than two samples succeeded."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n")]
    g = scores.groupBy(key).agg(*aggs)
    ok = None
    for m in metrics:
        c = F.col(f"{m}_n") >= 2
        ok = c if ok is None else ok & c
    cols = [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
    return g.select(key, *[F.when(ok, F.col(c)).alias(c) for c in cols])


def corpus_metric_mean(per_prompt: DataFrame, cols) -> DataFrame:
    return per_prompt.agg(*[F.avg(c).alias(c) for c in cols])


def metric_histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin over [lo, hi); values outside go to the edge bins."""
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))
    return (df.where(F.col(col).isNotNull()).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def invalid_candidate_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.col("valid")).cast("bigint").alias("invalid"),
                  F.count(F.lit(1)).cast("bigint").alias("total"))


# ---- T18 -----------------------------------------------------------------------------------
def score_candidates(cands: DataFrame, desc_col: str = "description") -> DataFrame:
    """Per valid candidate: truncated text, BLEU/GLEU vs reference, readability of the
    normalised truncated text."""
    v = cands.where(F.col("valid"))
    v = truncate_to_ref(v, desc_col, "reference", "text")
    refs = cands.select("prompt_id", "reference").dropDuplicates(["prompt_id"])
    bg = bleu_gleu(v, refs)
    r = readability(v.withColumn("norm", metric_normalize(F.col("text"))), "norm")
    return r.select("prompt_id", "sample_id", "text", "flesch", "coleman", "gunning").join(
        bg, ["prompt_id", "sample_id"])
