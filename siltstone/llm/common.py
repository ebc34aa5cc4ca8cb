"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_scratch: list[list[tuple[SparkSession, str]]] = []
_local_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without that setting (as tests do); it then
    gets a temporary folder.  On a cluster a missing setting is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_fallback:
        _local_fallback.append(tempfile.mkdtemp(prefix="siltstone-"))
    return "file://" + _local_fallback[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    (_scratch[-1] if _scratch else _written).append((spark, path))
    return path


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Paths made inside are removed at its end: for steps whose result is written elsewhere before."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            delete_path(spark, path)


def materialize(df: DataFrame, label: str, *, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage beyond those files, so that a lost executor costs
    one rescan and no recomputation, and its statistics are known to Catalyst.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more, before their scratch ends."""
    for table in tables:
        if path := getattr(table, "_written_path", None):
            delete_path(table.sparkSession, path)


#: Shuffle files go when their query ends, not when the driver's garbage collector comes to it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, every query's shuffle files are removed at its end: for steps of many queries that write their results."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of :func:`new_path` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone already
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def long_array(values: list[int]) -> Column:
    """A constant array<bigint>, cheap to build for thousands of values."""
    return F.expr(f"from_json('[{','.join(str(int(v)) for v in values)}]', 'array<bigint>')")


def spread(total: int, per_bucket: int, most: int) -> int:
    """How many buckets hold ``total`` rows at about ``per_bucket`` each."""
    return max(1, min(most, math.ceil(total / per_bucket)))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as decimal text, leaves that remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` documents for Python functions over whole
    texts: with Spark's default of 10,000, long texts would make them large.  A
    session that sets its own number keeps it.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
