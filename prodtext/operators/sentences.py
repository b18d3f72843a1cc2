"""Sentence boundaries learned from the corpus (T1), without labelled text.

A word type is an abbreviation if a period follows it far more often than chance allows: the
log-likelihood ratio of "a period follows with probability 0.99" against "as often as after any
word", weighed down by the type's length and by each occurrence without a period, weighed up by
periods inside it.  A word is a sentence starter if it follows a sure sentence end more often than
its frequency explains (log-likelihood ratio of two binomials).  A period after an abbreviation
ends a sentence only before a starter that begins with a capital letter.

Counts cover the whole corpus: texts are exploded to tokens once, equal tokens are summed before
the shuffle, and all patterns run on distinct tokens.  Neither table is broadcast by a hint; a
document gets the abbreviations and starters among its own tokens, one short array each.

Defined results: null text has no sentence; blank sentences are dropped; repeated rows are rows of
their own; a corpus without periods, or where a period follows every word, teaches no abbreviation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodtext.functions.text import SEP
from prodtext.session import cut_lineage

BLANK = r"\x20\x09-\x0D"
ABBREVIATION_FROM = 0.3
STARTER_FROM = 30.0
_LIKELY = 0.99  # how often a period follows an abbreviation


def core_of(token: Column) -> Column:
    """The token from its first letter or digit on."""
    return F.regexp_replace(token, r"\A[^\p{L}\p{N}]+", "")


def type_of(token: Column) -> Column:
    """Lower case, without marks at either end; periods inside stay."""
    return F.lower(F.regexp_replace(core_of(token), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z", ""))


def dotted(token: Column) -> Column:
    """A period follows the last letter or digit."""
    return core_of(token).rlike(r"[\p{L}\p{N}]\.[^\p{L}\p{N}.]*\z")


def _exclaimed(token: Column) -> Column:
    return core_of(token).rlike(r"[\p{L}\p{N}][!?][^\p{L}\p{N}]*\z")


def token_types(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, n_dot) of every type that holds a letter, as a stored table."""
    tokens = df.select(F.explode(F.split(text, f"[{BLANK}]+")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(tokens.withColumn("word", type_of(F.col("token"))).where(F.col("word").rlike(r"\p{L}"))
                       .groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(dotted(F.col("token")), F.col("n")).otherwise(0)).alias("n_dot")))


def learn_abbreviations(types: DataFrame, least: float = ABBREVIATION_FROM) -> DataFrame:
    """(word, n, n_dot, score) of the types of ``token_types`` that score ``least`` or more."""
    chance = types.agg(F.sum("n_dot") / F.sum("n")).first()[0]
    if not chance or chance == 1:
        return types.limit(0).withColumn("score", F.lit(0.0))
    p = F.lit(chance)
    bare = F.col("n") - F.col("n_dot")
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    periods = F.length("word") - letters
    ratio = 2 * (F.col("n_dot") * (F.log(F.lit(_LIKELY)) - F.log(p)) + bare * (F.log(F.lit(1 - _LIKELY)) - F.log(1 - p)))
    score = ratio * F.exp(-letters) * (periods + 1) * F.pow(letters.cast("double"), -bare.cast("double"))
    return (types.where("n_dot > 0").withColumn("score", score)
            .where(F.col("score") >= least).select("word", "n", "n_dot", "score"))


def _loglik(k: Column, n: Column, p: Column) -> Column:
    """Binomial log-likelihood, 0 ln 0 being 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def learn_starters(df: DataFrame, types: DataFrame, abbreviations: DataFrame, text: str = "text", least: float = STARTER_FROM) -> DataFrame:
    """(word, n, n_start, ratio) of the words that begin sentences more often than chance allows.  A sure
    end is a token with ! or ?, or with a period and not an abbreviation."""
    pattern = f"(?<![^{BLANK}])([^{BLANK}]*[.!?][^{BLANK}]*)(?=[{BLANK}]+([^{BLANK}]+))"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))
    pairs = df.select(F.explode(found).alias("x")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ends = (pairs.withColumn("ended", type_of(F.col("a"))).withColumn("dot", dotted(F.col("a"))).where(F.col("dot") | _exclaimed(F.col("a")))
            .withColumn("word", type_of(F.col("b"))).where(F.col("word").rlike(r"\p{L}")))
    known = abbreviations.select(F.col("word").alias("ended"), F.lit(True).alias("short"))
    starts = (ends.join(known, "ended", "left").where("short IS NULL OR NOT dot").groupBy("word").agg(F.sum("n").alias("n_start")))
    starts = cut_lineage(starts)
    b, n = (F.lit(float(t.agg(F.sum(x)).first()[0] or 0)) for t, x in ((starts, "n_start"), (types, "n")))
    s, c = F.col("n_start").cast("double"), F.col("n").cast("double")
    s_out = F.greatest(c - s, F.lit(0.0))
    apart = _loglik(s, b, s / b) + F.when(n > b, _loglik(s_out, n - b, s_out / (n - b))).otherwise(0.0)
    alike = _loglik(s, b, c / n) + _loglik(s_out, n - b, c / n)
    return (starts.join(types.select("word", "n"), "word").withColumn("ratio", 2 * (apart - alike))
            .where((F.col("ratio") >= least) & (s / b > c / n)).select("word", "n", "n_start", "ratio"))


def split_learned(df: DataFrame, key: str, abbreviations: DataFrame, starters: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """``df`` with the sentences of each row's text.  ``key`` names a column by which a row finds the
    abbreviations and starters among its tokens; rows of one key, or of none, share them, which changes nothing."""
    cuts = F.split(F.regexp_replace(text, f"([.!?])([{BLANK}]+)", f"$1{SEP}$2"), SEP)
    marked = df.select(key, F.explode(F.split(text, f"[{BLANK}]+")).alias("token")).where(F.col("token") != "")
    words = marked.select(key, "token", type_of(F.col("token")).alias("word"))
    short = words.where(dotted(F.col("token"))).join(abbreviations.select("word"), "word", "left_semi").groupBy(key).agg(F.collect_set("word").alias("short_"))
    # only documents with an abbreviation have a boundary to decide
    first = words.join(short.select(F.col(key).alias("key_")), F.col(key).eqNullSafe(F.col("key_")), "left_semi").join(starters.select("word"), "word", "left_semi").groupBy(key).agg(F.collect_set("word").alias("starts_"))
    held = df
    for lists in (short, first):
        lists = lists.withColumnRenamed(key, "key_")
        held = held.join(lists, held[key].eqNullSafe(lists["key_"]), "left").drop("key_")
    held = held.withColumn("cuts_", cuts).withColumn("next_", F.slice("cuts_", 2, F.greatest(F.size("cuts_"), F.lit(1))))

    def glue(x: Column) -> Column:
        last = F.regexp_extract(x["cuts_"], f"(?<![^{BLANK}])[^{BLANK}]++\\z", 0)
        after = F.regexp_extract(x["next_"], f"\\A[{BLANK}]*([^{BLANK}]+)", 1)
        capital = F.substring(core_of(after), 1, 1)
        begins = F.coalesce(F.array_contains("starts_", type_of(after)), F.lit(False)) & (capital != F.lower(capital))
        goes_on = x["next_"].isNotNull() & dotted(last) & F.array_contains("short_", type_of(last)) & ~begins
        return F.concat(x["cuts_"], F.when(goes_on, F.lit("")).otherwise(F.lit(SEP)))

    decided = F.split(F.array_join(F.transform(F.arrays_zip("cuts_", "next_"), glue), ""), SEP)
    joined = F.when(F.col("short_").isNull(), F.col("cuts_")).otherwise(decided)
    strip = lambda s: F.regexp_replace(s, f"\\A[{BLANK}]+|[{BLANK}]+\\z", "")
    return held.withColumn(out, F.filter(F.transform(joined, strip), lambda s: s != "")).drop("short_", "starts_", "cuts_", "next_")
