"""The candidate search must not lose any pair: compare with brute force over all pairs."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from prodtext.operators import clean as CL

CRAFTED = [
    "the panel is bright and the colours are vivid", "the panel is bright and the colors are vivid",
    "the panel is bright, and the colours are vivid!", "a completely different sentence about sound",
    "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaab", "ab", "axb", "ba", "", "a", "b", "abc", "xyz xyz xyz", "xyz xyz xyy", "é😀", "é😀a",
]


def brute(rows, ratio):
    out = set()
    by = {}
    for k, i, s in rows:
        by.setdefault(k, []).append((i, s))
    for k, lst in by.items():
        lst = [(i, s) for i, s in lst if "#" not in s]
        for i, a in lst:
            for j, b in lst:
                if i < j and SequenceMatcher(None, a, b).ratio() > ratio:
                    out.add((k, i, j))
    return out


@pytest.mark.parametrize("ratio", [0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95])
def test_candidates_are_exact_on_short_texts(spark, ratio):
    df = spark.createDataFrame([(-1, i, s) for i, s in enumerate(CRAFTED)], "k long, i int, s string")
    got = {(r.k, r.i, r.j) for r in CL.near_dup_pairs(df, ["k"], ratio).collect()}
    assert got == brute([(-1, i, s) for i, s in enumerate(CRAFTED)], ratio)


def test_candidates_are_exact_on_reviews(spark, sf_dir):
    sents = E.queries()["dedupe_sentences"](spark, sf_dir).select(
        (F.col("prompt_id") * 10 + F.col("sample_id")).alias("k"), (F.col("sent_ord") - 1).alias("i"), F.col("sentence").alias("s"))
    rows = [(r.k, r.i, r.s) for r in sents.collect()]
    got = {(r.k, r.i, r.j) for r in CL.near_dup_pairs(sents, ["k"], 0.9).collect()}
    assert got == brute(rows, 0.9) and got


def test_size_of_a_review_does_not_matter(spark):
    """The same pairs in a review of two sentences and in one of three hundred."""
    few = [(0, 0, "ab"), (0, 1, "axb")]
    many = [(1, 0, "ab"), (1, 1, "axb")] + [(1, i, f"q{i}w{i * 7}") for i in range(2, 300)]
    df = spark.createDataFrame(few + many, "k long, i int, s string")
    got = {(r.k, r.i, r.j) for r in CL.near_dup_pairs(df, ["k"], 0.7).collect()}
    assert {(0, 0, 1), (1, 0, 1)} <= got


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_characters_are_never_shuffled(spark):
    """One exchange gathers a review; its characters and candidate pairs are no rows."""
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(CRAFTED)], "k long, i int, s string")
    assert _exchanges(CL.near_dup_pairs(df, ["k"], 0.9)) == 1
    reviews = spark.createDataFrame([(1, "One two three. One two three four. Five.")], "k long, text string")
    assert _exchanges(CL.clean_review(reviews, ["k"])) == 1


def test_rows_of_one_key_and_null_keys(spark):
    """Each copy of a sentence meets each copy of a later one; null keys meet nothing."""
    rows = [(k, i, s) for k in (1, 1, 2, None) for i, s in enumerate(["the same words here", "the same words there", "something else"])]
    got = sorted((r.k, r.i, r.j) for r in CL.near_dup_pairs(spark.createDataFrame(rows, "k long, i int, s string"), ["k"], 0.9).collect())
    assert got == [(1, 0, 1)] * 4 + [(2, 0, 1)]
    text = "The same words here. The same words there. Something else."
    df = spark.createDataFrame([(1, "a", text), (1, "b", text), (2, "c", text), (None, "d", text), (None, "e", text), (3, "f", None)], "k long, name string, text string")
    cleaned = sorted((r.name, r.clean) for r in CL.clean_review(df, ["k"]).collect())
    once = "The same words here. Something else."
    twice = "The same words here. The same words here. Something else. Something else."
    assert cleaned[:5] == [("a", twice)] * 2 + [("b", twice)] * 2 + [("c", once)]
    assert cleaned[5:] == [("d", None), ("e", None), ("f", None)]
