"""C5 title case / istitle, sentence split, syllables, normalisation vs Python semantics."""

import re

from pyspark.sql import functions as F

from prodtext.functions import text as T

WORDS = ["wi-fi", "usb 2 0 port", "hDMI", "4k ultra hd", "it's", "sound_modes", "Étion dans", "a1b2c", "", "x"]
TITLES = ["Hello World", "4K", "MB", "It's", "Hello world", "Étion Des", "A", "", "123", "Wi-Fi", "hello"]


def test_title_case_matches_python(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "s string")
    got = {r.s: r.t for r in df.select("s", T.title_case("s").alias("t")).collect()}
    for w in WORDS:
        assert got[w] == w.title(), w


def test_is_title_matches_python(spark):
    df = spark.createDataFrame([(w,) for w in TITLES], "s string")
    got = {r.s: r.t for r in df.select("s", T.is_title("s").alias("t")).collect()}
    for w in TITLES:
        assert got[w] == w.istitle(), w


def test_sentence_split_and_words(spark):
    df = spark.createDataFrame([("One. Two!  Three? four",)], "s string")
    r = df.select(T.sentence_split("s").alias("p"), T.word_array("s").alias("w")).first()
    assert r.p == ["One.", "Two!", "Three?", "four"]
    assert r.w == "One. Two!  Three? four".split()


def test_syllables_and_normalize(spark):
    df = spark.createDataFrame([("  <h2>Beautiful</h2>   QUEUE <br> a  ",)], "s string")
    r = df.select(T.syllable_estimate(F.lit("beautiful")).alias("y"), T.metric_normalize("s").alias("n")).first()
    assert r.y == len(re.findall("[aeiouy]+", "beautiful"))
    expected = re.sub(r"\s\s+", " ", "  <h2>Beautiful</h2>   QUEUE <br> a  ".replace("<h2>", "").replace("</h2>", "")
                      .replace("<br>", "").strip().lower())
    assert r.n == expected


def test_words_are_parted_by_any_white_space(spark):
    text = "one\u00a0two\u2003three\x1cfour\x85five \u3000"
    r = spark.createDataFrame([(text,)], "s string").select(T.word_array("s").alias("w"), T.strip_ws("s").alias("p")).first()
    assert r.w == text.split() and r.p == text.strip()
