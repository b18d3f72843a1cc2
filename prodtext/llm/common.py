"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prodtext.session import delete_at_end

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).  Only a local session may
    leave it unset; it then gets a scratch folder, as driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="prodtext-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


WORDS_HELD = 50_000  # words that a worker remembers a result for
ROWS_PER_FILE = 100_000
SCAN_BYTES = 128 << 20


def files_for(rows: int) -> int:
    return 1 + rows // ROWS_PER_FILE


def gathered(df: DataFrame) -> DataFrame:
    """A table whose splits are small (many short files) in fewer tasks: at least SCAN_BYTES each,
    but four tasks for each core.  Splits of that size or more stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # huge where unknown
    return df.coalesce(min(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SCAN_BYTES)), 1 << 30))


def cut(df: DataFrame, label: str = "table", rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back: later
    readers neither recompute it nor depend on the executors that made it, and the planner
    knows its real size.  The table is deleted when the session's JVM ends.

    ``rows``, a bound on the number of (short) rows where the caller knows one, sets the number of
    files: as many as ROWS_PER_FILE asks for, not one for each shuffle partition."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    (df if rows is None else df.coalesce(files_for(rows))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value of any class of this package; the function returned gives it in a task.
    It travels pickled by value, is unpickled once in a worker process, and stays with the
    broadcast variable, so what it gathers there (a memo, an encoder) serves later tasks, until
    ``release`` is called."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        if getattr(data, "unpickled", None) is None:
            data.unpickled = pickle.loads(data.value)
        return data.unpickled

    _SHIPPED.append((spark.sparkContext, data, get))
    return get


_SHIPPED: list = []


def release(spark: SparkSession, only: Callable[[], object] | None = None) -> None:
    """Have executors and their Python workers drop all values shipped so far, or that of ``only``.
    Nothing that still has to run may need them: call it between steps whose results are written."""
    gone = [x for x in _SHIPPED if x[0] is spark.sparkContext and only in (None, x[2])]
    for _, data, _ in gone:
        data.destroy()
    _SHIPPED[:] = [x for x in _SHIPPED if x not in gone]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words are runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_long(*parts: Column) -> Column:
    """Non-negative 60-bit hash that other SQL engines can repeat: the first 15 hex digits of
    the md5 of the parts, joined by a colon (null: the word null)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id written as text, modulo n (null doc_id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
