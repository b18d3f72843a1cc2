"""What the two text classifiers share: the bounded labelled sample, hashed terms of a text,
and calibration.

The sample is the only part of the data that passes the driver.  It holds at most
``per_class`` rows of each label, those with the lowest hash of doc_id, whatever the size of
the tables: of the rows that repeat a sampled doc_id one stays, chosen by its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodtext.llm.common import crc_mod


def sampled_labels(labels: DataFrame, label: str, folds: int, per_class: int) -> DataFrame:
    """(doc_id, y): a bounded sample of the labels outside the held-out remainder 0.  A doc_id
    with two different labels is left out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != 0))
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).where("y = top").select("doc_id", F.col("y").cast("int").alias("y")))
    order = [F.xxhash64(F.lit("sample"), F.col("doc_id")), F.col("doc_id")]
    return known.where("y = 1").orderBy(*order).limit(per_class).union(known.where("y = 0").orderBy(*order).limit(per_class))


def class_counts(labels: DataFrame, label: str, folds: int) -> tuple[int, int]:
    """Numbers of labels 0 and 1 outside the held-out rows, over all of them."""
    y = F.col(label)
    found = labels.where(y.isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != 0)).agg(F.sum((y == 0).cast("long")), F.sum((y == 1).cast("long"))).first()
    return found[0] or 0, found[1] or 0


def collect_features(docs: DataFrame, sample: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the sampled documents, in an order that does not depend on how
    the tables are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([features(t.as_py() or "") for t in b.column("text")], pa.list_(pa.int32()))
            keys = pa.array([zlib.crc32(x.values.to_numpy().tobytes()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), keys, ids], ["doc_id", "y", "key", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # the sample's size is bounded by its limits, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, key long, ids array<int>")
    table = rows.groupBy("doc_id", "y").agg(F.min(F.struct("key", "ids")).alias("first")).select("doc_id", "y", F.col("first.ids").alias("ids")).toArrow()
    ids = table.column("ids").combine_chunks()
    values, offsets = ids.flatten().to_numpy(), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    keys = [(d, zlib.crc32(values[a:z].tobytes())) for d, a, z in zip(table.column("doc_id").to_pylist(), offsets[:-1], offsets[1:])]
    order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(str(keys[i]).encode()), keys[i]))
    return [values[offsets[i]:offsets[i + 1]].astype(np.int64) for i in order], table.column("y").to_numpy()[order].astype(np.float64) if len(order) else np.empty(0)


def scored(docs: DataFrame, score_of: Callable[[str], float], folds: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, null text counting as empty."""
    return (docs.select("doc_id", score_column(score_of)(F.col("text")).alias("score"))
            .select("doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def score_column(score_of: Callable[[str], float]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([score_of(t.as_py() or "") for t in texts], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a logistic link from margins to labels (Newton steps, smoothed
    targets, so separable margins give finite values)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.abs(margin).mean() or 1.0
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-6 * c
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        c -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0] / scale), float(c[1])


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))
