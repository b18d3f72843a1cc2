"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks of bytes.  All blocks are sorted, and each distinct block
gets an integer as its name.  Then adjacent names are paired, the pairs are named in the same
way, and so on until every document is one integer.  Names are given after comparing whole
contents (a hash only routes and pre-sorts), so equal names mean equal texts: no collision.

A key is named once for each task that holds it, not once for each occurrence: a task
replaces equal keys by one local entry, only local entries are shuffled and sorted, and the
names come back to the occurrences by local id.  A block that a third of all rows share
thus costs each task one row.

Defined results: null text counts as empty, which is one empty block; texts are compared
after lower-casing A-Z only; of equal texts the row with the largest doc_id stays (null is
smallest; of repeated rows one stays); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodtext.llm.common import cut, files_for, gathered

FLUSH_BYTES, FLUSH_ROWS = 16 << 20, 50_000


def _local_entries(rows_of: Callable, fields: list[str], types: list[pa.DataType]) -> Callable:
    """mapInArrow function: equal keys of a task become one entry (lid, key, occurrences).
    Entries are handed on when the keys held exceed a bound; a key may then come again."""
    occurrence = pa.struct(list(zip(fields, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        held: dict[bytes, list] = {}
        n_entries = n_bytes = n_rows = 0

        def entries() -> Iterator[pa.RecordBatch]:
            nonlocal n_entries, n_bytes, n_rows
            keys = list(held)
            for at in range(0, len(keys), 256):
                part = keys[at:at + 256]
                lids = pa.array(range(task + n_entries, task + n_entries + len(part)), pa.int64())
                n_entries += len(part)
                yield pa.RecordBatch.from_arrays([lids, pa.array(part, pa.binary()), pa.array([held[k] for k in part], pa.list_(occurrence))], ["lid", "key", "occ"])
            held.clear()
            n_bytes = n_rows = 0

        for key, fields_of in rows_of(batches, task):
            if key in held:
                held[key].append(fields_of)
            else:
                held[key] = [fields_of]
                n_bytes += len(key) + 64
            n_rows += 1
            if n_bytes > FLUSH_BYTES or n_rows > FLUSH_ROWS:
                yield from entries()
        yield from entries()

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys in, (lid, name) out: a new integer whenever the key changes."""
    task, name, last = TaskContext.get().partitionId() << 40, -1, None
    for b in batches:
        names = []
        for key in b.column("key").to_pylist():
            if key != last:
                name, last = name + 1, key
            names.append(task + name)
        yield pa.RecordBatch.from_arrays([b.column("lid"), pa.array(names, pa.int64())], ["lid", "name"])


def _named(keyed: DataFrame, rows_of: Callable, schema: T.StructType, label: str) -> DataFrame:
    """Table of the occurrences of all keys that ``rows_of`` finds, each with its key's name."""
    fields = schema.fieldNames()
    arrow = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() if isinstance(f.dataType, T.StringType)
             else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in schema]
    out = T.StructType([T.StructField("lid", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("occ", T.ArrayType(schema))])
    entries = cut(keyed.mapInArrow(_local_entries(rows_of, fields, arrow), out), f"{label}-entries")
    n_entries, n_rows = entries.agg(F.count(F.lit(1)), F.sum(F.size("occ"))).first()
    names = (entries.select("lid", "key", F.xxhash64("key").alias("h")).repartition("h").sortWithinPartitions("h", "key")
             .select("lid", "key").mapInArrow(_number, "lid long, name long"))
    # an exchange of short rows: names are given per partition, so these may not be merged
    names = cut(names.repartition(files_for(n_entries)), f"{label}-names")
    named = entries.select("lid", "occ").join(names, "lid").select("name", F.explode("occ").alias("o")).select("o.*", "name")
    return cut(named, label, rows=n_rows or 0)


def _blocks(block_bytes: int) -> Callable:
    def rows_of(batches, task):
        row = task
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = (text.as_py() or b"").lower()  # of bytes: A-Z only
                n = max(1, -(-len(data) // block_bytes))
                sha = hashlib.sha256(data).digest()
                for i in range(n):
                    head = {"doc_id": doc_id, "n": n, "sha": sha} if i == 0 else {"doc_id": None, "n": n, "sha": None}
                    yield data[i * block_bytes:(i + 1) * block_bytes], {"row": row, "idx": i, **head}
                row += 1
    return rows_of


def _pairs(batches, task):
    for b in batches:
        for row, n, idx, a, z in zip(*(b.column(c).to_pylist() for c in ("row", "n", "idx", "a", "z"))):
            yield a.to_bytes(8, "big", signed=True) + z.to_bytes(8, "big", signed=True), {"row": row, "n": n, "idx": idx}


def exact_duplicates(docs: DataFrame, block_bytes: int = 16384) -> DataFrame:
    """One row per document: doc_id, n_blocks, name (equal for equal texts of so many blocks),
    keep_id, group_size, kept, text_sha256."""
    id_type = docs.schema["doc_id"].dataType
    if not isinstance(id_type, (T.StringType, T.BinaryType)):
        id_type = T.LongType()
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("doc_id", id_type),
                           T.StructField("n", T.IntegerType()), T.StructField("sha", T.BinaryType())])
    texts = gathered(docs.select(F.col("doc_id").cast(id_type), F.col("text").cast("binary").alias("text")))
    state = _named(texts, _blocks(block_bytes), schema, "dedup-blocks")
    left = state.where("n > 1").select("row", "n", "idx", "name")
    blocks, n_rows, n_left = state.agg(F.max("n"), F.count_if(F.col("idx") == 0), F.count_if(F.col("n") > 1)).first()
    blocks = blocks or 1
    pair_schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("idx", T.IntegerType())])
    done = left.where("false").select("row", F.col("name").alias("last"))
    while blocks > 1:
        pairs = (left.groupBy("row", "n", (F.col("idx") / 2).cast("int").alias("half"))
                 .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("z"))
                 .select("row", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("idx"), "a", "z"))
        n_left = (n_left + 1) // 2  # about half as many names are left; the files' number needs no more
        named = _named(pairs.coalesce(files_for(n_left)), _pairs, pair_schema, "dedup-pairs")
        done = done.union(named.where("n = 1").select("row", "name"))
        left = named.where("n > 1")
        blocks = -(-blocks // 2)
    heads = (state.where("idx = 0").select("row", "doc_id", F.col("n").alias("n_blocks"), "name", "sha").join(done, "row", "left")
             .select("row", "doc_id", "n_blocks", F.coalesce("last", "name").alias("name"), "sha"))
    heads = cut(heads, "dedup-heads", rows=n_rows)
    # a table of its own: the join's sides are then plain shuffles, whose large keys can be split
    groups = heads.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups, "dedup-groups", rows=n_rows)
    return (heads.join(groups, ["n_blocks", "name"])
            .select("doc_id", "n_blocks", "name", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))
