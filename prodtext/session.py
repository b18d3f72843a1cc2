"""SparkSession construction and cluster-safe lineage cutting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # floor for AQE coalescing: small-but-CPU-heavy shuffles (text explode, Arrow UDF input)
    # keep their parallelism; irrelevant once partitions are naturally large
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "prodtext", cpus: int | str = "*", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and benches; on a cluster use the provided session."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("PRODTEXT_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SCRATCH = "_prodtext_scratch"


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process (``local[n]``; ``local-cluster`` is not)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or the
    context's checkpoint folder.  Only a local session may leave both unset; it gets a
    scratch folder.  On a cluster that would lose rows, so it is an error there."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, _SCRATCH, None)
    if not current:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="prodtext-ckpt-")
        setattr(spark, _SCRATCH, current)
        delete_at_end(spark, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver's JVM ends."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the end of the session."""
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written, else they stay until the
    driver happens to collect its garbage.  Only for results that are read from what was written."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a parquet table in the shared checkpoint folder and read it
    back: lineage is cut, the result survives executor loss, it is computed exactly once
    (``Dataset.checkpoint`` would compute it twice without a cache) and the planner sees its
    real size.  The shuffles that made it are deleted with its writing."""
    spark = df.sparkSession
    path = scratch_path(spark, "mat")
    with shuffles_freed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
