"""Incremental ingest: files once each, state in the checkpoint, running totals by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltstone.sources.shared import shared_path


def ingest(spark: SparkSession, source: str, schema: StructType, process: Callable[[DataFrame, int], None], checkpoint: str, *, files_per_batch: int = 5, glob: str = "*") -> StreamingQuery:
    """Processes every file of a folder that the checkpoint has not seen, some at a time, and ends."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(spark: SparkSession, file: str, schema: StructType) -> DataFrame:
    """Per-batch totals of a stream over the file's folder: each batch is written under its number, so that a replayed batch replaces itself."""
    folder, name = file.rsplit("/", 1)
    work = shared_path(spark, "stream")
    sink = f"{work}/totals"

    def process(batch: DataFrame, number: int) -> None:
        totals_by_type(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    ingest(spark, folder, schema, process, f"{work}/state", glob=name).awaitTermination()
    return spark.read.parquet(sink)


def running_pattern_usage(tables: DataFrame) -> DataFrame:
    """Running counts and totals per pattern, for ``complete`` output."""
    return tables.groupBy("pattern_id").agg(F.count("*").alias("tables"), F.sum("total_computed").alias("total"))


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rows whose event_id was not seen within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def reconciled(wanted: DataFrame, state: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(open, stale): wanted rows that the state does not have as done, and state rows that are no longer wanted."""
    done = state.where("status = 'ok'").select(key)
    return wanted.join(done, key, "left_anti"), state.join(wanted.select(key), key, "left_anti")


def to_rerun(state: DataFrame, most_tries: int = 3) -> DataFrame:
    """Rows whose last try failed and that have tries left."""
    return state.where((F.col("status") == "error") & (F.col("tries") < most_tries))


def without_output(wanted: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Rows whose output does not exist yet."""
    return wanted.join(outputs.select(key), key, "left_anti")
