"""Quoted files read by many tasks: CSV with line ends inside quotes, JSON arrays of strings, and
lists whose line numbers matter.

Spark splits a text file at any line end, or at any other separator, so the question is only what
state a split begins in.  A row of the file flips the state (inside or outside quotes) or leaves it,
and adds a weight (records, commas, lines) if it begins outside.  Each split is scanned for both
possible states at its begin; a running sum over the splits of a file, one short row each, then
tells which of the two holds and what the splits before have added.  The largest window is one split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_rows(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, split, at, value): the stretches between separators; ``at`` ascends inside a split."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def scan_state(rows: DataFrame, flips: Column, weight: Column) -> DataFrame:
    """``rows`` with ``inside`` (the row begins inside quotes) and ``ahead`` (the weights of the rows
    before it in its file that begin outside).

    The splits' sums and the rows are read from one shuffle of the file, so both see the same splits;
    should a planner read the file twice and split it anew, the sizes differ and the query fails."""
    split = Window.partitionBy("file", "split")
    before = split.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    held = (rows.withColumn("flips", flips.cast("long")).withColumn("weight", weight.cast("long")).withColumn("odd", seen(F.col("flips")) % 2)
            .withColumn("w0", F.when(F.col("odd") == 0, F.col("weight")).otherwise(0)).withColumn("w1", F.col("weight") - F.col("w0"))
            .withColumn("b0", seen(F.col("w0"))).withColumn("b1", seen(F.col("w1"))))
    n, size = F.count(F.lit(1)), F.sum(F.octet_length("value"))
    splits = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(splits), F.lit(0))
    states = (held.groupBy("file", "split").agg(F.sum("flips").alias("f"), F.sum("w0").alias("s0"), F.sum("w1").alias("s1"), n.alias("n"), size.alias("size"))
              .withColumn("begin", earlier(F.col("f")) % 2).withColumn("base", earlier(F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1"))))
              .select("file", "split", "begin", "base", "n", "size"))
    known = held.withColumn("n_", n.over(split)).withColumn("size_", size.over(split)).join(states, ["file", "split"], "left")
    ahead = F.col("base") + F.when(F.col("begin") == 0, F.col("b0")).otherwise(F.col("b1"))
    same = (F.col("n") == F.col("n_")) & (F.col("size") == F.col("size_"))
    return known.select(*rows.columns, ((F.col("odd") + F.col("begin")) % 2 == 1).alias("inside"),
                        F.when(same, ahead).otherwise(F.raise_error(F.lit("the splits of a file changed while it was read"))).cast("long").alias("ahead"))


def _joined(pieces: DataFrame, separator: str) -> DataFrame:
    """(file, key, value) of pieces (file, split, at, key, value, first, last): those of one key in order.
    Pieces of one split are put together where they are; only what may cross a split's border moves."""
    ordered = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "value"))), lambda x: x["value"]), separator)
    local = pieces.groupBy("file", "split", "key").agg(ordered("at").alias("value"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"))
    whole = F.col("first") & F.col("last")
    rest = local.where(~whole).groupBy("file", "key").agg(ordered("split").alias("value"))
    return local.where(whole).select("file", "key", "value").unionByName(rest)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, record): the records of CSV files, from 1 in each file, the header among them.
    Quotes inside a quoted field are doubled, and no unquoted field holds one; lines end with \\n or
    \\r\\n; empty lines are no records.  A quote that is never closed makes the rest of its file a
    record, as in any CSV reader."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = file_rows(spark, path)
    lines = scan_state(rows, quotes, F.lit(1))
    closes = (quotes % 2 == 1) == F.col("inside")  # the line ends outside
    # a line that begins outside is a record's first; one that begins inside belongs to the last such
    pieces = lines.select("file", "split", "at", "value", (F.col("ahead") + F.when(F.col("inside"), 0).otherwise(1)).alias("key"),
                          (~F.col("inside")).alias("first"), closes.alias("last"))
    return _joined(pieces, "\n").select("file", F.col("key").alias("ord"), F.regexp_replace("value", "\r\\z", "").alias("record")).where("record <> ''")


def read_json_strings(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_ord, text): files that are one JSON array each, of strings, nulls or plain values (as
    text), however long their lines.  A file is cut at its quotes: a stretch that ends with an odd number
    of backslashes ends at an escaped quote and flips nothing; commas outside strings number the elements.
    Arrays inside the array are not meant; the empty array has no rows."""
    escaped = F.length(F.regexp_extract("value", r"(\\*)\z", 1)) % 2 == 1
    commas = F.length("value") - F.length(F.replace("value", F.lit(","), F.lit("")))
    parts = scan_state(file_rows(spark, path, '"'), F.when(escaped, 0).otherwise(1), commas)
    # a string's key is the number of commas before it; its first piece follows one that is outside (not
    # known at a split's begin, where the piece may go on from the split before)
    follows = F.lag("inside").over(Window.partitionBy("file", "split").orderBy("at"))
    inner = parts.withColumn("first", F.coalesce(~follows, F.lit(False))).where("inside")
    strings = _joined(inner.select("file", "split", "at", F.col("ahead").alias("key"), "value", "first", (~escaped).alias("last")), '"')
    texts = strings.select("file", (F.col("key") + 1).alias("doc_ord"), F.from_json(F.concat(F.lit('["'), "value", F.lit('"]')), "array<string>")[0].alias("text"))
    outside = parts.where("NOT inside").select("file", "ahead", F.posexplode(F.split("value", ",")).alias("pos", "token"))
    token = F.regexp_replace("token", r"[\s\[\]]", "")
    plain = outside.where(token != "").select("file", (F.col("ahead") + F.col("pos") + 1).alias("doc_ord"), F.when(token != "null", token).alias("text"))
    return texts.unionByName(plain)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, value): the lines of each file, numbered from 1; \\r before a line end is dropped."""
    lines = scan_state(file_rows(spark, path), F.lit(0), F.lit(1))
    return lines.select("file", (F.col("ahead") + 1).alias("ord"), F.regexp_replace("value", "\r\\z", "").alias("value"))
