"""File sources (S3, S4, S5, S8): Spark readers with explicit schemas/options; files whose quotes or
line numbers matter are read by ``splittable``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodtext.sources.splittable import read_csv_records, read_json_strings, read_numbered_lines


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """S3: JSON documents, one per line; ``multi_line`` for files that are one document or an
    array (each such file is one task's)."""
    r = spark.read.option("multiLine", multi_line)
    if schema:
        r = r.schema(schema)
    return r.json(path)


def parse_json_column(df: DataFrame, col: str, schema: str, out: str = "parsed") -> DataFrame:
    """S3 for JSON held in a string column (e.g. event properties)."""
    return df.withColumn(out, F.from_json(F.col(col), schema))


def read_line_list(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """Ordered line list, blank lines kept as '' (like str.splitlines on the whole file).
    Output (_file, ord, value) with 1-based ordinals; one row per line of each file, which many tasks read."""
    return read_numbered_lines(spark, path).select(F.col("file").alias("_file"), "ord", F.col("value").alias(value))


def read_descriptions_csv(spark: SparkSession, path: str, index_col: str = "_c0") -> DataFrame:
    """CSV with a header on each file's first line and quoted multi-line fields; the unnamed index
    column is dropped.  An empty field is null, a quoted empty one the empty text (and a text that is
    one NUL character is null).  Quotes are doubled inside fields; one large file is many tasks'."""
    columns = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"escape": '"', "nullValue": "\0", "multiLine": "true", "lineSep": "\n"}
    rows = read_csv_records(spark, path).where("ord > 1").select(F.from_csv("record", schema, options).alias("r"))
    return rows.select(*[F.col("r")[c].alias(c) for c in columns if c not in (index_col, "", "Unnamed: 0")])


def read_json_string_array(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """JSON arrays of strings -> (doc_ord, text), doc_ord from 1 in each array.  A file is one
    array, read by many tasks, or with ``per_line`` each of its lines is."""
    if not per_line:
        return read_json_strings(spark, path).select("doc_ord", "text")
    return spark.read.text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "text")).select(
        (F.col("pos") + 1).alias("doc_ord"), "text")


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ``sinks.write_json_arrays`` -> (group, doc_ord, text), doc_ord from 1 in each
    group.  Lines are of bounded size and Spark splits them over tasks."""
    lines = spark.read.text(path).select(F.from_json("value", "`group` string, first bigint, items array<string>").alias("line"))
    return lines.select("line.group", "line.first", F.posexplode("line.items").alias("pos", "text")).select(
        "group", (F.col("first") + F.col("pos")).alias("doc_ord"), "text")
