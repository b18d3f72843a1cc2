"""The corpus pipeline: toxicity, SimHash near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
Stages that drop documents find them by a row id.  It is given once, in a copy of the stage's
input that is written to the shared folder, and read from there by the operator and by the join
that drops rows: an id made anew at each reading would follow the splits, which can change.
As its input is written, a stage first has executors drop the models of the stage before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodtext.llm import decontamination, mixing, sharding, simhash, toxicity
from prodtext.llm.common import cut, free_name, gathered, read_documents, release, shared_dir
from prodtext.session import delete_at_end

TOXIC_FROM = 0.5

#: no SQL: a fitted factorization machine, XXH64 fingerprints and a greedy packing
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written once with an id for each row, and the id's name."""
    row = free_name(docs, "row_no")
    return cut(gathered(docs).withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores below the threshold; labels come from the table."""
    score = toxicity.toxicity_column(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxic_score")
    return docs.withColumn(name, score).where(F.col(name) < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id."""
    release(spark)
    numbered, row = _numbered(docs)
    found = simhash.near_duplicates(numbered, shingle=3, max_distance=3, row=row)
    gone = cut(found.where("NOT kept").select(F.col("row").alias(row)), "pipeline-gone", rows=numbered.count())
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    release(spark)
    numbered, row = _numbered(docs)
    found = decontamination.decontaminate(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, slop=0, row=row)
    gone = cut(found.where(F.size("spans") > 0).select(F.col("row").alias(row)), "pipeline-gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: whole ones, repeated ones and parts."""
    release(spark)
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        delete_at_end(spark, path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
