"""Tables written to the folder that driver and executors share, to cut lineage and recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_paths: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a temporary one only where a local master has none."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="siltstone-"))
        known = "file://" + _local[0]
    path = f"{known.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    """Removes what this driver has written, as far as its session still lives."""
    for spark, path in _paths:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from Parquet: computed once however many branches read them."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
