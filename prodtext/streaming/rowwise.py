"""Row-wise operators on Structured Streaming.

The source workflow has no streaming, windows or state.  What carries over is
that every row-wise operator here (tag stripping, description extraction,
record parsing, metric normalisation, readability) is a plain column
expression, so the same function applies to a streaming DataFrame.  This
module wires a file source to a parquet sink with a checkpoint in the shared
checkpoint folder; nothing stateful is claimed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from prodtext.session import ensure_checkpoint_dir


def stream_rowwise(spark: SparkSession, source_dir: str, schema, op: Callable[[DataFrame], DataFrame],
                   sink_dir: str, name: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """readStream(source_dir) -> op -> writeStream parquet(sink_dir), checkpointed."""
    ckpt = f"{ensure_checkpoint_dir(spark)}/stream-{name}"
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    w = op(src).writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", sink_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
