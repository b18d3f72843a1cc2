"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal text form a group that stays together.  Groups that hold more than
1/``bundles`` of any measure are packed one by one (there are at most 3 * ``bundles`` of
them); all smaller groups are summed into ``bundles`` hash bundles.  So the packing sees at
most 4 * ``bundles`` vectors, however large the table is, and runs on the driver.  Largest
first, each goes to the shard where the dot product of its vector with the shard's residual
capacity is highest.  A group with more than 1/``whole`` of a shard's bytes would leave the sizes
unequal in one piece: its rows are dealt out in turn to pieces of 1/``fine``.

Defined results: null text has no bytes (size 1, crc32 0) and is a group apart from empty
text; repeated rows get slots of their own; an empty table gives an empty result; null
doc_id is a value like any other; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodtext.llm.common import cut, gathered, word_count


def pack(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each vector, given in the order of placing.  Columns are measured in
    capacities of one shard (column sum / n_shards); a column that sums to 0 is ignored."""
    total = vectors.sum(axis=0)
    v = vectors / np.where(total > 0, total / n_shards, 1.0)
    residual = np.where(total > 0, 1.0, 0.0) * np.ones((n_shards, v.shape[1]))
    out = np.empty(len(v), dtype=np.int32)
    for i, x in enumerate(v):
        best = int(np.argmax(residual @ x))  # the first of equals
        out[i] = best
        residual[best] -= x
    return out


def shard_documents(docs: DataFrame, n_shards: int = 8, bundles: int = 4096, chunk_rows: int = 4096, whole: int = 2, fine: int = 64) -> DataFrame:
    """One row per document: doc_id, size, tokens, text_crc32, shard, slot (gapless from 0 in
    each shard).  ``chunk_rows`` is the aim for the rows that one window numbers."""
    spark = docs.sparkSession
    rows = cut(gathered(docs).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        word_count(F.col("text")).alias("tokens"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.col("text"), 256)), F.lit(b"null")).alias("digest")), "shard-rows")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    n_rows = total[2]
    part = [F.col(c) / F.lit(float(t or 1)) for c, t in zip(("size", "tokens", "n"), total)]
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")
    single = F.greatest(*part) > 1.0 / bundles
    found = (groups.groupBy(F.when(single, F.col("digest")).alias("digest"), F.when(~single, bundle).alias("bundle"))
             .agg(*[F.sum(c).cast("double").alias(c) for c in ("size", "tokens", "n")]).collect())  # 4 * bundles rows at most

    items, large, next_id = [], [], bundles
    capacity = [max((t or 0) / n_shards, 1e-9) for t in total]
    for r in sorted(found, key=lambda r: (r["digest"] is None, bytes(r["digest"] or b""), r["bundle"] or 0)):
        vector = np.array([r["size"], r["tokens"], r["n"]])
        if r["digest"] is None:
            items.append((r["bundle"], vector))
            continue
        load = r["size"] / capacity[0]
        pieces = 1 if load * whole <= 1 else int(min(r["n"], math.ceil(fine * load)))
        large.append((bytearray(r["digest"]), next_id, pieces))
        items += [(next_id + i, vector / pieces) for i in range(pieces)]
        next_id += pieces
    matrix = np.array([v for _, v in items]).reshape(-1, 3)
    order = sorted(range(len(items)), key=lambda i: (-max(matrix[i] / np.array(capacity)), items[i][0]))
    where = pack(matrix[order], n_shards)
    placed = [(items[i][0], int(s)) for i, s in zip(order, where)]

    large_df = spark.createDataFrame(large, T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first_item", T.IntegerType()), T.StructField("pieces", T.IntegerType())]))
    shard_df = spark.createDataFrame(placed, T.StructType([T.StructField("item", T.IntegerType()), T.StructField("shard", T.IntegerType())]))
    chunks = max(64, math.ceil(n_rows / chunk_rows))
    chunk = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id"), F.col("text_crc32")), F.lit(chunks))
    found = rows.withColumn("chunk", chunk).join(large_df, "digest", "left")
    whole = found.where("pieces IS NULL OR pieces = 1").withColumn("item", F.coalesce("first_item", bundle))
    if any(pieces > 1 for _, _, pieces in large):
        # rows of a group in pieces are dealt out in turn
        split = _numbered(found.where("pieces > 1"), ["digest"], "turn")
        whole = whole.unionByName(split.withColumn("item", (F.col("first_item") + F.col("turn") % F.col("pieces")).cast("int")).drop("turn"))
    sharded = cut(whole.join(shard_df, "item").select("doc_id", "size", "tokens", "text_crc32", "digest", "shard", "chunk"), "shard-placed", rows=n_rows)
    return _numbered(sharded, ["shard"], "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def _numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add ``out``: numbers from 0 without gaps for each value of ``keys``.  Rows are numbered
    inside (keys, chunk), and chunks follow each other, so no task sees all rows of a key."""
    ahead = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys, "chunk").orderBy(F.col("doc_id").asc_nulls_first(), *([] if "digest" in keys else ["digest"]))
    return (rows.withColumn("_rank", F.row_number().over(inside)).join(offsets, [*keys, "chunk"])
            .withColumn(out, (F.col("_offset") + F.col("_rank") - 1).cast("long")).drop("_rank", "_offset"))
