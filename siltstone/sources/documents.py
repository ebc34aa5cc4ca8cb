"""Readers of documents, reports, logs and labels; slugs, parts and links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import slug
from siltstone.operators.lines import reassemble

#: The names under which documents hold their text; the first that is there counts.
TEXT_FIELDS = ("rawText", "text", "raw_text", "content", "body", "fullText", "data")
#: The text that stands for a file whose parsing is skipped.
SKIPPED_TEXT = "Parsing skipped."
BRONZE = "id string, slug string, part int, source string, length bigint, " + ", ".join(f"{f} string" for f in TEXT_FIELDS) + ", metadata struct<id:string,originalName:string,size:bigint,uploadedAt:string,pageCount:int>, _corrupt_record string"


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, text, pages, error) of JSON documents, one per file; broken files become rows with an error."""
    raw = spark.read.schema(BRONZE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    file_id = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.select(F.coalesce("id", "slug", file_id).alias("doc_id"), "part", F.coalesce(*TEXT_FIELDS).alias("text"), F.col("metadata.pageCount").alias("pages"), F.when(F.col("_corrupt_record").isNotNull(), F.lit("unreadable")).alias("error"))


def whole_first(documents: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, text): the whole document where there is one, else its parts in order."""
    whole = documents.where("part is null and text is not null").select("doc_id", "text")
    parts = documents.where("part is not null").join(whole, "doc_id", "left_anti")
    return whole.unionByName(reassemble(parts, "doc_id", separator).select("doc_id", "text"))


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Report JSON files under an explicit schema; unreadable files are left out."""
    # the corrupt-record column must be looked at together with the others, so it is cached by file, not pruned away
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return raw.where(F.col("_corrupt_record").isNull()).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).drop("_corrupt_record")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; lines that are none are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def gold_labels(reports: DataFrame) -> DataFrame:
    """(report_id, category, text) of gold reports with an array per category; a missing array is not scored."""
    categories = ("goals", "bmps", "activities", "metrics")
    parts = [reports.where(F.col(c).isNotNull()).select("report_id", F.lit(c).alias("category"), F.explode_outer(c).alias("text")) for c in categories if c in reports.columns]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def parsed_or_quarantined(files: DataFrame, parsers: Sequence[Callable[[Column], Column]]) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantined) of (path, content): the first parser that gives a text counts.

    A parser maps the content to struct<text, pages, error>; a row whose parsers all
    fail goes to quarantine with every error, and a text of blanks is ``empty-text``.
    """
    tried = files.select("path", F.array(*[parse(F.col("content")) for parse in parsers]).alias("_t"))
    good = F.filter("_t", lambda x: x["error"].isNull() & x["text"].isNotNull())
    tried = tried.withColumn("_g", F.get(good, F.lit(0)))
    empty = F.trim(F.col("_g.text")) == ""
    error = F.when(F.col("_g").isNull(), F.array_join(F.transform("_t", lambda x: F.coalesce(x["error"], F.lit("no text"))), "; ")).when(empty, F.lit("empty-text"))
    tried = tried.withColumn("error", error)
    return tried.where("error IS NULL").select("path", "_g.text", "_g.pages"), tried.where("error IS NOT NULL").select("path", "error")


def uploads(files: DataFrame, extension: str = ".pdf", skip_parse: bool = False) -> DataFrame:
    """Files that an upload accepts, with their name; with ``skip_parse`` a fixed text and no pages stand for the content."""
    named = files.where(F.lower("path").endswith(extension)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return named.select("path", "name", F.lit(SKIPPED_TEXT).alias("text"), F.lit(0).alias("pages")) if skip_parse else named


def stored_metric(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A metric table that an audit wrote, or None where none was written."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).json(path)


def page_lines(items: DataFrame) -> DataFrame:
    """(doc_id, text) from text items (doc_id, page, seq, x, y, text): lines by rounded height, top down, left to right."""
    placed = items.where(F.trim("text") != "").withColumn("_row", F.floor(F.col("y") + 0.5))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", F.trim("text").alias("t")))), lambda i: i["t"]), " ")
    lines = placed.groupBy("doc_id", "page", "_row").agg(line.alias("line"))
    page = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_row")).alias("o"), "line"))), lambda i: i["line"])
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(page, "\n").alias("text"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy("doc_id").agg(F.array_join(whole, "\n\n").alias("text"))


def links(pages: DataFrame, target: str = r"\.pdf") -> DataFrame:
    """Distinct link targets of pages (page_id, url, html) that end in the pattern."""
    found = F.regexp_extract_all("html", F.lit(rf'href="([^"]*{target})"'), F.lit(1))
    return pages.select(F.explode(found).alias("link")).distinct()


def unique_slugs(names: DataFrame, name: str, order: str, existing: DataFrame | None = None, numbered: int = 50) -> DataFrame:
    """Adds ``slug``; later ones of equal slug get -2 to -50, counting those that exist already, and behind them eight hexadecimal digits.

    ``order`` is a unique column.  Only the first ranks are numbered, which Spark
    cuts down before the shuffle: a very common slug is no heavy task.
    """
    base = names.withColumn("_b", slug(F.col(name)))
    taken = F.lit(0)
    if existing is not None:
        known = existing.select(F.regexp_replace("slug", r"-\d+$", "").alias("_b")).groupBy("_b").agg(F.count("*").alias("_taken"))
        base, taken = base.join(known, "_b", "left"), F.coalesce("_taken", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    first = base.select("_b", order).withColumn("_n", rank).where(F.col("_n") <= numbered)
    base = base.join(first, ["_b", order], "left").withColumn("_n", F.col("_n") + taken)
    late = F.substring(F.sha1(F.concat_ws("-", "_b", F.col(order).cast("string")).cast("binary")), 1, 8)
    suffix = F.when(F.coalesce("_n", F.lit(numbered + 1)) > numbered, late).when(F.col("_n") > 1, F.col("_n").cast("string"))
    return base.withColumn("slug", F.concat_ws("-", "_b", suffix)).drop("_b", "_n", "_taken")


def year_alias(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """For ids without a file of their own: the largest file of the id with a year (and part) behind it."""
    family = F.regexp_replace("file", r"-(?:19|20)\d{2}(?:-(?:part)?\d+)?$", "")
    aliased = files.where(F.col("file").rlike(r"-(?:19|20)\d{2}(?:-(?:part)?\d+)?$")).groupBy(family.alias("id")).agg(F.max_by("file", "size").alias("alias"))
    own = files.select(F.col("file").alias("id"), F.col("file").alias("own"))
    return wanted.join(own, "id", "left").join(aliased, "id", "left").select("id", F.coalesce("own", "alias").alias("file"))
