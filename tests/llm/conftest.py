import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns
    whose names the operators use themselves."""
    rows = [
        (1, "One two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "a", 27),
        (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \t\n\x0b\x0c\r ", "de", None, 7), (None, "one two three four five six", None, "a", None),
        (None, None, None, None, None), (6, LONG, "fr", "c", len(LONG)), (7, LONG + "x", "fr", "c", len(LONG) + 1), (8, "é😀 Ünïcode words here", "fr", "b", 25),
        (9, "<|im_end|>", "xx", "", 10), (10, "12345 !!! ???", "en", "b", 13),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("row", "size", "shard", "fp", "name", "n", "idx", "target", "taken", "score", "words", "Row_No", "toxic_score", "mix_row"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
