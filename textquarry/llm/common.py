"""Shared plumbing: the shared folder, intermediate tables, and sizes that decide partition counts."""

from __future__ import annotations

import atexit
import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is missing and all runs in one process (tests) is a temporary folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="textquarry-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/textquarry-{spark.sparkContext.applicationId}"


def _drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder then stays
        pass


#: Paths that were made and not deleted yet.
_MADE: dict[str, None] = {}


def scratch() -> list[str]:
    return list(_MADE)


def forget(spark: SparkSession, paths: list[str | None]) -> None:
    """Delete paths of the shared folder that nothing reads any more."""
    for path in paths:
        if path in _MADE:
            del _MADE[path]
            _drop_path(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is left of it is removed when the driver's interpreter ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = None
    atexit.register(forget, spark, [path])
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        forget(df.sparkSession, [df.scratch_path])


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives its worker's memory back when its task ends."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: what JVM and Python hold of a batch counts against an executor's memory twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release() -> None:
    """Give freed memory of a Python worker back to the system; allocators otherwise keep it between groups."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_for(df: DataFrame, column: str, each: int = 16 << 20) -> int:
    """Partitions of about ``each`` bytes of ``column``, at least the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))


def parts(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``limit`` bytes of text, so that working arrays stay small."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = held = 0
        for i, n in enumerate(sizes):
            if i > first and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        if batch.num_rows > first:
            yield batch.slice(first)
