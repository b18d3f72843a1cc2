"""File sinks (S9-S12): distributed writers, one output folder per result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodtext.operators.annotate import strip_tags_expr
from prodtext.session import cut_lineage


def write_records(df: DataFrame, path: str, col: str = "record", compression: str = "none") -> None:
    """One record per line; a compressed file is read by one task."""
    df.select(col).write.mode("overwrite").option("compression", compression).text(path)


def write_product_json(df: DataFrame, path: str, key: str = "product_id", buckets: int = 64) -> None:
    """Products as JSON lines, found by bucket: a product is in the folder bucket=<hash of
    its id modulo ``buckets``>, one file each, so neither folders nor files grow with the products."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def write_text(df: DataFrame, path: str, col: str) -> None:
    """Plain text result, one value per line."""
    df.select(col).write.mode("overwrite").text(path)


def write_annotation_corpora(tagged: DataFrame, path: str, col: str = "tagged_text") -> None:
    """Tagged and untagged corpora as JSON lines under path/tagged and path/untagged."""
    tagged.select("doc_id", F.col(col).alias("text")).write.mode("overwrite").json(f"{path}/tagged")
    tagged.select("doc_id", strip_tags_expr(F.col(col)).alias("text")).write.mode("overwrite").json(f"{path}/untagged")


def write_json_arrays(df: DataFrame, path: str, col: str, group: str, order: str, array_bytes: int = 1 << 20, chunk_rows: int = 4096) -> None:
    """JSON arrays of strings, elements by ``order`` in each ``group``, in lines of bounded size:
    {group, first, items}, with ``first`` the place of the first item in its group, from 1.

    Keys without texts are dealt to ranges of (group, order), about ``chunk_rows`` each, and numbered
    inside (group, range); ranges follow each other.  An array ends at ``array_bytes`` and holds one
    text beyond that at most.  Texts of equal ``order`` lie by hash; equal ones are interchangeable."""
    bare = df.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(col).alias("item"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(bare)  # written, so that the ids hold
    size = F.coalesce(F.octet_length("item"), F.lit(0)) + 1
    keys = rows.select("group", "order", F.xxhash64("item").alias("tie"), "row", size.alias("size"))
    ranges = max(1, -(-rows.count() // chunk_rows))
    dealt = cut_lineage(keys.repartitionByRange(ranges, "group", "order", "tie", "row").withColumn("chunk", F.spark_partition_id()))
    ahead = Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("group", "chunk").agg(F.count(F.lit(1)).alias("n"))
               .select(F.col("group").alias("of"), F.col("chunk").alias("at"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("group", "chunk").orderBy("order", "tie", "row")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (dealt.withColumn("rank", F.row_number().over(inside)).withColumn("piece", F.floor(before / array_bytes))
              .join(offsets, F.col("group").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
              .select("row", "chunk", "piece", (F.col("offset") + F.col("rank")).alias("place")))
    lines = (rows.select("group", "row", "item").join(placed, "row").groupBy("group", "chunk", "piece")
             .agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("items")))
    line = F.struct("group", F.col("items")[0]["place"].alias("first"), F.transform("items", lambda x: x["item"]).alias("items"))
    lines.select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)


def write_descriptions_csv(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """CSV with header and quoted fields, as ``readers.read_descriptions_csv`` reads them.  Null is an
    empty field, the empty text a quoted one; white space at either end stays.  Quoted line ends make
    a file one task's, so files are many: no more than ``rows_per_file`` rows each."""
    (df.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""').option("maxRecordsPerFile", rows_per_file)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
