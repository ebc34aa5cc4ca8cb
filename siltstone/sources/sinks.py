"""Writers: flat exports, key-value sheets, logs and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_rows(goals: DataFrame, bmps: DataFrame) -> DataFrame:
    """Export rows of goals and practices (doc_id, pos, text, more): commas become blanks, the last field stays empty."""

    def part(rows: DataFrame, section: str, prefix: str, rank: int) -> DataFrame:
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
        return rows.select(
            "doc_id", F.lit(rank).alias("_rank"), "pos", F.lit(section).alias("Section"), F.concat(F.lit(prefix), number.cast("string")).alias("ID"),
            F.regexp_replace("text", ",", " ").alias("Field1"), F.coalesce("more", F.lit("")).alias("Field2"), F.lit("").alias("Field3"),
        )

    return part(goals, "Goals", "G", 0).unionByName(part(bmps, "BMPs", "B", 1))


def write_csv(rows: DataFrame, path: str) -> None:
    """One folder per document, rows in export order."""
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "_rank", "pos")
    ordered.select("doc_id", "Section", "ID", "Field1", "Field2", "Field3").write.mode("overwrite").partitionBy("doc_id").option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """One JSON object per line, with the time of writing."""
    rows.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).write.mode("append").json(path)


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changed keys' rows replaced and new ones added."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def without(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the given keys; asking for missing ones is fine."""
    return current.join(gone.select(key), key, "left_anti")


def newest(copies: DataFrame, key: str, time: str = "modificationTime") -> DataFrame:
    """Of several copies of a key the newest."""
    rest = [c for c in copies.columns if c != key]
    return copies.groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("r")).select(key, "r.*")


def write_bronze(documents: DataFrame, path: str, day: Column | None = None) -> None:
    """Appends documents, by day of ingest."""
    documents.withColumn("ingest_date", day if day is not None else F.current_date()).write.mode("append").partitionBy("ingest_date").parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a versioned table's versions that were written to the end, ascending."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [s.getPath().getName() for s in files.listStatus(root)]
    return sorted(int(x[8:]) for x in found if x.startswith("version=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS")))


def read_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest (or a given) version of a versioned table; earlier ones are its backups."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    return spark.read.parquet(f"{path}/version={version if version is not None else known[-1]}")


def upsert(changes: DataFrame, path: str, key: str) -> DataFrame:
    """Writes a new version in which the changed keys' rows are replaced.

    The version before stays as it was: a write that fails, or a reader that is
    under way, does no harm.
    """
    spark = changes.sparkSession
    known = versions(spark, path)
    current = read_current(spark, path)
    whole = changes if current is None else upserted(current, changes, key)
    number = known[-1] + 1 if known else 0
    whole.write.mode("overwrite").parquet(f"{path}/version={number}")
    return spark.read.parquet(f"{path}/version={number}")


def sheets(report: dict[str, DataFrame], metadata: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """The eight sheets of a report's export: two of keys and values, six of rows.

    metadata has one row; so has summary, whose ``categories`` map becomes ``bmpCategories.<name>`` keys.
    """
    pairs = lambda d, names: d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])).alias("p")).select("p.*")
    plain = [c for c in summary.columns if c != "categories"]
    flat = summary.select(F.explode("categories").alias("k", "v")).select(F.concat(F.lit("bmpCategories."), "k").alias("key"), F.col("v").cast("string").alias("value")) if "categories" in summary.columns else None
    pick = lambda name, columns: report[name].select(*[F.col(c) if c in report[name].columns else F.lit(None).cast("string").alias(c) for c in columns])
    return {
        "Metadata": pairs(metadata, metadata.columns),
        "Summary": pairs(summary, plain).unionByName(flat) if flat is not None else pairs(summary, plain),
        "Goals": pick("goals", ["id", "title", "status", "pollutant", "reduction_percent", "baseline_value", "target_value", "unit", "deadline", "confidence"]),
        "BMPs": pick("practices", ["id", "name", "category", "quantity", "unit", "verb", "confidence"]),
        "Implementation": pick("implementation", ["id", "description", "date", "target", "achieved"]),
        "Monitoring": pick("monitoring", ["id", "metric", "source"]),
        "Outreach": pick("outreach", ["id", "activity", "audience", "source"]),
        "Geography": pick("geography", ["id", "area", "source"]),
    }


def accuracy_export(panel: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row's provenance (kind, id, text, source, confidence) as JSON behind the panel's metrics, in one table (part, payload)."""
    as_json = lambda d, part: d.select(F.lit(part).alias("part"), F.to_json(F.struct(*[F.col(c) for c in d.columns])).alias("payload"))
    return as_json(panel, "metrics").unionByName(as_json(rows, "row"))
