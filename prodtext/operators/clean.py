"""Generated-text cleaning.

A review is split into sentences (regex in place of a trained sentence tokenizer),
de-duplicated in order, title-wrapped, near-duplicates dropped, and re-joined.
Sentence pairs of one review meet by rare common characters,
an exact bound on common characters thins them out, and the
exact Ratcliff-Obershelp ratio is computed of the pairs that are left, in the task that has the review.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prodtext.functions.constants import NEAR_DUP_RATIO
from prodtext.functions.stopwords import STOPWORDS_EN
from prodtext.functions.text import SENTENCE_BREAK, SEP, is_title, replace_all, strip_ws, word_array


# ---- T1 ------------------------------------------------------------------------------------
def sentences_expr(text):
    """Pre-replacements, sentence split, strip, drop blanks, cut each sentence's last char."""
    t = replace_all(text, [("</h2>  <br>", "</h2> <br> "), ("..", ".")])
    parts = F.split(F.regexp_replace(t, SENTENCE_BREAK, "$1" + SEP), SEP)
    parts = F.filter(F.transform(parts, lambda s: strip_ws(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.substring(s, 1, F.length(s) - 1))


def dealt_out(reviews: DataFrame, keys) -> DataFrame:
    """Reviews by key over the tasks, as a file's row groups can be fewer than the cores."""
    return reviews.repartition(*keys)


def sentence_split(df: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    return df.withColumn(out, sentences_expr(F.col(text)))


def sentence_split_dot(df: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """Split on '.', drop empty strings (decimals are cut; a lone space survives)."""
    return df.withColumn(out, F.filter(F.split(F.col(text), r"\."), lambda s: s != ""))


# ---- A3 ------------------------------------------------------------------------------------
def dedupe_sentences(df: DataFrame, col: str = "sentences") -> DataFrame:
    return df.withColumn(col, F.array_distinct(col))  # keeps first occurrence order


# ---- T2 / C5 -------------------------------------------------------------------------------
def title_of(sentence):
    kept = F.filter(word_array(sentence), lambda w: ~F.lower(w).isin(*STOPWORDS_EN))
    return F.array_join(kept, " ")


def title_wrap_expr(arr):
    # a one-element array binds the title, which is made once
    return F.transform(arr, lambda s: F.when(F.exists(F.array(title_of(s)), is_title), F.concat(F.lit("\n\n#### "), s, F.lit("\n\n")))
                       .otherwise(s))


def title_detect(df: DataFrame, col: str = "sentences") -> DataFrame:
    return df.withColumn(col, title_wrap_expr(F.col(col)))


def title_detect_blank(df: DataFrame, col: str = "sentences") -> DataFrame:
    """Variant: a sentence after an empty element that is Title Case is wrapped
    (no spaces inside the marker); blanks are dropped."""
    arr = F.col(col)
    wrapped = F.transform(arr, lambda s, i: F.when(
        (i > 0) & (F.element_at(arr, i) == "") & is_title(s), F.concat(F.lit("\n\n####"), s, F.lit("\n\n"))).otherwise(s))
    return df.withColumn(col, F.filter(wrapped, lambda s: s != ""))


# ---- P13 -----------------------------------------------------------------------------------
def sentence_blacklist(df: DataFrame, phrases, col: str = "sentences") -> DataFrame:
    """Drop sentences whose lower-case form contains a blacklisted phrase."""
    if not phrases:
        return df
    bad = None
    for p in phrases:
        c_ = lambda s, p=p: F.instr(F.lower(s), p.lower()) > 0
        bad = c_ if bad is None else (lambda s, b=bad, c2=c_: b(s) | c2(s))
    return df.withColumn(col, F.filter(col, lambda s: ~bad(s)))


# ---- T4 ------------------------------------------------------------------------------------
class _Sentences:
    """The sentences of one review by their place, as character counts, and the rarest first characters
    of each (its marks) by which the others find it.

    difflib's ratio is 2M/(la+lb), and M is at most the number of characters (with
    repetition) that both sentences hold.  So ratio > r needs 2*min(la, lb)/(la+lb) > r, hence
    lb >= la*r/(2-r), and more than la*r/(2-r) common characters.  Sets of character
    occurrences (character, k-th) with so many in common share one among the first
    len - floor(len*r/(2-r)) of each in any common order; the order is by rarity in
    the review.  Only sentences that share such an occurrence meet; then the
    bound 2*common/(la+lb) > r is computed exactly, then the ratio.  This holds for every ratio in (0, 1) and
    every length, and is the only route.  Texts of one place and length count together, as rows that
    repeat a key do."""

    def __init__(self, places, texts, ratio: float):
        self.ratio = ratio
        self.texts: dict = {}
        counts: dict = {}
        for i, s in zip(places, texts):
            if "#" not in s:
                self.texts.setdefault(i, Counter())[s] += 1
                counts.setdefault((i, len(s)), Counter()).update(s or ("",))  # an empty sentence has a mark of its own, so that empty ones can meet
        frequency: Counter = Counter()
        for c in counts.values():
            frequency.update(c)
        self.at: dict = {}
        for (i, length), c in counts.items():
            left = max(1, length - math.floor(length * (ratio / (2.0 - ratio)) - 1e-9))
            marks = []
            for _, ch, n in sorted((frequency[ch], ch, n) for ch, n in c.items()):
                marks += [(ch, k) for k in range(min(n, left))]
                left -= n
                if left <= 0:
                    break
            self.at.setdefault(i, []).append((length, c, marks))

    def _bounded(self, i, j) -> int:
        """In how many ways the characters at two places allow a ratio above the threshold."""
        n = 0
        for la, a, _ in self.at[i]:
            for lb, b, _ in self.at[j]:
                if la + lb == 0:
                    n += 1 > self.ratio
                elif 2.0 * sum(min(x, b[ch]) for ch, x in a.items() if ch in b) / (la + lb) > self.ratio:
                    n += 1
        return n

    def candidates(self):
        """(i, j, n): i < j whose character bound exceeds the threshold, in n ways; j by j."""
        index: dict = {}
        for j in sorted(self.at):
            met = set()
            for lb, _, marks in self.at[j]:
                for m in marks:
                    met.update(i for i, la in index.get(m, ()) if i not in met and (la + lb == 0 or 2.0 * min(la, lb) > self.ratio * (la + lb) - 1e-9))
            for length, _, marks in self.at[j]:
                for m in marks:
                    index.setdefault(m, []).append((j, length))
            for i in sorted(met):
                if n := self._bounded(i, j):
                    yield i, j, n

    def ratios(self):
        """(i, j, ratio, n): difflib's SequenceMatcher(None, a, b).ratio() of the candidates' texts (argument
        order matters, autojunk on), n times."""
        match = SequenceMatcher(None)
        second = None  # what difflib works out of a second text serves all first ones
        for i, j, n in self.candidates():
            for b, nb in self.texts[j].items():
                if b != second:
                    match.set_seq2(b)
                    second = b
                for a, na in self.texts[i].items():
                    match.set_seq1(a)
                    yield i, j, match.ratio(), n * na * nb

    def repeated(self) -> set:
        """Places of the sentences that an earlier one resembles; each ends at the first found."""
        found: set = set()
        match = SequenceMatcher(None)
        second = None
        for i, j, _ in self.candidates():
            if j in found:
                continue
            for b in self.texts[j]:
                if b != second:
                    match.set_seq2(b)
                    second = b
                for a in self.texts[i]:
                    match.set_seq1(a)
                    if match.ratio() > self.ratio:
                        found.add(j)
        return found


# ---- J7 ------------------------------------------------------------------------------------
ROWS_A_BATCH = 1 << 16


def near_dup_pairs(sent: DataFrame, keys, ratio: float = NEAR_DUP_RATIO, scored_only: bool = False) -> DataFrame:
    """(keys, i, j, ratio) for i < j, neither containing '#', ratio(s_i, s_j) > ``ratio``.

    A review's sentences are gathered by its keys and its pairs found there: no character and no
    candidate pair is ever a row.  ``scored_only`` returns all candidates, also those at or below the
    threshold: the pairs whose common characters alone would allow a higher ratio."""
    keys = list(keys)
    s = sent.where(~F.col("s").contains("#")).dropna(subset=[*keys, "i"])  # a null key meets nothing
    reviews = s.groupBy(*keys).agg(F.collect_list("i").alias("_i"), F.collect_list("s").alias("_s"))
    place = sent.schema["i"].dataType
    out = T.StructType([*[sent.schema[k] for k in keys], T.StructField("i", place), T.StructField("j", place), T.StructField("ratio", T.DoubleType())])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def rows(b, at, found):
        return pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())).cast(schema.field(k).type) for k in range(len(keys))],
                                           *[pa.array([x[n] for x in found], schema.field(len(keys) + n).type) for n in range(3)]], schema=schema)

    def run(batches):
        for b in batches:
            at, found = [], []
            for row, (places, texts) in enumerate(zip(b.column("_i"), b.column("_s"))):
                for i, j, r, n in _Sentences(places.as_py(), texts.as_py(), ratio).ratios():
                    if scored_only or r > ratio:
                        for _ in range(n):
                            at.append(row), found.append((i, j, r))
                            if len(at) >= ROWS_A_BATCH:
                                yield rows(b, at, found)
                                at, found = [], []
            if at:
                yield rows(b, at, found)

    return reviews.mapInArrow(run, out)


def explode_sentences(df: DataFrame, keys, col: str = "sentences") -> DataFrame:
    # outer, as the filter that the planner adds to the plain one makes the sentences a second time
    return df.select(*keys, F.posexplode_outer(col).alias("i", "s")).where(F.col("i").isNotNull())


def drop_near_duplicates(df: DataFrame, keys, col: str = "sentences", ratio: float = NEAR_DUP_RATIO, rows: str | None = None) -> DataFrame:
    """Remove sentence j when any earlier sentence i (even one removed itself) is similar;
    not transitive and order independent.  Rows of one key get the sentences of all of them, one of a null
    key none.  ``rows`` names a column for the number of rows of the key (1 for a null key)."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in (*keys, col)]
    null = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    own = F.when(null, F.xxhash64(col))  # rows of a null key have nothing to do with each other
    each = df.select(*keys, own.alias("_own"), F.struct(F.lit(0).alias("_"), *rest).alias("_row"), F.transform(col, lambda s, i: F.struct(i.alias("i"), s.alias("s"))).alias("_k"))
    groups = each.groupBy(*keys, "_own").agg(F.collect_list("_row").alias("_rows"), F.array_sort(F.flatten(F.collect_list("_k"))).alias("_k"))
    groups = groups.withColumn("_k", F.when(~null, F.col("_k")))

    @F.pandas_udf("array<boolean>")
    def kept_udf(places: pd.Series, texts: pd.Series) -> pd.Series:
        def kept(i, s):
            if i is None:
                return None
            gone = _Sentences(i, s, ratio).repeated()
            return [x not in gone for x in i]
        return pd.Series([kept(i, s) for i, s in zip(places, texts)], dtype=object)

    groups = groups.withColumn("_kept", kept_udf(F.transform("_k", lambda x: x["i"]), F.transform("_k", lambda x: x["s"])))
    kept = F.transform(F.filter("_k", lambda x, i: F.get("_kept", i)), lambda x: x["s"])
    n = F.when(null, F.lit(1)).otherwise(F.size("_rows"))
    out = groups.select(*keys, *([n.alias(rows)] if rows else []), F.coalesce(kept, F.array().cast("array<string>")).alias(col), F.explode("_rows").alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], *([rows] if rows else []), col)


# ---- W7 ------------------------------------------------------------------------------------
def join_sentences_expr(arr):
    """s1 then, per next sentence, '. ' + s unless the previous one contains '#'; final '.'."""
    rest = F.transform(F.slice(arr, 2, 1 << 30), lambda x, i: F.concat(
        F.when(F.instr(F.element_at(arr, i + 1), "#") == 0, F.lit(". ")).otherwise(F.lit("")), x))
    return F.when(F.size(arr) > 0, F.concat(F.element_at(arr, 1), F.array_join(rest, ""), F.lit(".")))


# ---- J10 -----------------------------------------------------------------------------------
def heading_dedupe_expr(text):
    """For every heading pair (a, b), b later: remove '<br><h2> b </h2>', then triple spaces -> one.

    Pairs are worked off by a.  The pairs of one a are the headings behind it, and the next a
    has the same ones but for the first: once they change nothing, no later pair does, and the
    rest is skipped.  So the work is a few passes over the headings, not all pairs."""
    heads = F.regexp_extract_all(text, F.lit("<h2> ([^\n]*?) </h2>"), 1)
    n = F.size(heads)

    def step(acc, b):
        return F.replace(F.replace(acc, F.concat(F.lit("<br><h2> "), b, F.lit(" </h2>")), F.lit("")), F.lit("   "), F.lit(" "))

    def after(acc, a):
        # a one-element array binds the new text, which is then compared and kept
        new = F.array(F.aggregate(F.slice(heads, a + 2, n), acc["text"], step))
        return F.when(acc["moved"], F.element_at(F.transform(new, lambda x: F.struct(x.alias("text"), (x != acc["text"]).alias("moved"))), 1)).otherwise(acc)

    start = F.struct(text.alias("text"), F.lit(True).alias("moved"))
    done = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), start, after)
    return F.when(n >= 2, done["text"]).otherwise(text)


# ---- T5 ------------------------------------------------------------------------------------
def clean_review(df: DataFrame, keys, text: str = "text", out: str = "clean",
                 ratio: float = NEAR_DUP_RATIO, blacklist=()) -> DataFrame:
    """The whole cleaning chain; null when the text has no sentence."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    # the texts are dealt out once, and go with their sentences to the end
    s = dealt_out(df, keys).select("*", sentences_expr(F.col(text)).alias("_sentences"))
    s = title_detect(dedupe_sentences(s, "_sentences"), "_sentences")
    s = sentence_blacklist(s, list(blacklist), "_sentences")
    s = drop_near_duplicates(s, keys, "_sentences", ratio, rows="_n")
    s = s.select(*keys, *rest, heading_dedupe_expr(join_sentences_expr(F.col("_sentences"))).alias(out), "_n")
    # each row of a key meets each cleaned text of the key
    return s.select(*keys, *rest, out, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_n")).drop("_n")
