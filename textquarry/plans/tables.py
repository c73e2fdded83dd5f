"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is not set and all runs in one process (tests) a temporary folder is made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="textquarry-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/textquarry-{spark.sparkContext.applicationId}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder then stays
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what follows plans over columns, not over all the expressions behind them."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    # Shuffles of the write go with it: else their files lie on the executors' disks until the driver's next garbage collection.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        _drop(df.sparkSession, df.scratch_path)
