"""Queries of the service calls: displayed orders, filters, audits, reconciliation, readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import analytics as an
from siltstone.plans.registry import Tables, query
from siltstone.sources import documents as src
from siltstone.sources import sinks
from siltstone.sources.shared import shared_path
from siltstone.streaming import ingest as inc


def reports(t: Tables) -> DataFrame:
    """A list of reports: customers, with their orders as tables."""
    tables = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("tables"), F.round(F.sum("o_totalprice"), 2).alias("total_reported"), F.max("o_orderdate").alias("generated_at"))
    return t.customer.join(tables, "c_custkey", "left").select(F.col("c_name").alias("id"), "tables", "total_reported", F.round("c_acctbal", 2).alias("discrepancy"), "generated_at")


REPORTS = """WITH r AS (SELECT c_name AS id, n AS tables, s AS total_reported, round(c_acctbal, 2) AS discrepancy, d AS generated_at FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey),
p AS (SELECT id, row_number() OVER (ORDER BY {order}lower(id), id)::INTEGER AS place FROM r) SELECT id, place FROM p WHERE place <= 100"""


@query("reports_by_tables", REPORTS.format(order="coalesce(tables, 0) DESC, "))
def reports_by_tables(t: Tables) -> DataFrame:
    return an.ordered_reports(reports(t), "tables").select("id", "place")


@query("reports_by_reported", REPORTS.format(order="coalesce(total_reported, 0) DESC, "))
def reports_by_reported(t: Tables) -> DataFrame:
    return an.ordered_reports(reports(t), "reported").select("id", "place")


@query("reports_by_discrepancy", REPORTS.format(order="abs(coalesce(discrepancy, 0)) DESC, "))
def reports_by_discrepancy(t: Tables) -> DataFrame:
    return an.ordered_reports(reports(t), "discrepancy").select("id", "place")


@query("reports_by_time", REPORTS.format(order="generated_at DESC NULLS LAST, "))
def reports_by_time(t: Tables) -> DataFrame:
    return an.ordered_reports(reports(t), "recent").select("id", "place")


@query("reports_by_id", REPORTS.format(order=""))
def reports_by_id(t: Tables) -> DataFrame:
    return an.ordered_reports(reports(t)).select("id", "place")


@query("reports_with_costs_first", REPORTS.format(order="tables IS NULL, "))
def reports_with_costs_first(t: Tables) -> DataFrame:
    return an.costs_first(reports(t).withColumn("has_cost", F.col("tables").isNotNull())).select("id", "place")


@query("usage_order", """WITH u AS (SELECT p_type AS pattern_id, count(*) AS n FROM part GROUP BY 1), p AS (SELECT pattern_id, n::BIGINT AS tables, row_number() OVER (ORDER BY n DESC, pattern_id)::INTEGER AS place FROM u) SELECT * FROM p WHERE place <= 100""")
def usage_order(t: Tables) -> DataFrame:
    return an.ordered_usage(t.part.groupBy(F.col("p_type").alias("pattern_id")).agg(F.count("*").alias("tables")))


FUNDING = """WITH f AS (SELECT p_partkey AS id, p_name AS name, round(p_retailprice, 2) AS total, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS nrcs, (50 - p_size)::DOUBLE AS producer FROM part),
p AS (SELECT id, row_number() OVER (ORDER BY coalesce({by}, 0) DESC, lower(name), id)::INTEGER AS place FROM f) SELECT * FROM p WHERE place <= 100"""


def funded(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("double")
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round("p_retailprice", 2).alias("total"), F.when(F.col("p_size") % 2 == 0, size).alias("nrcs"), (50 - size).alias("producer"))


@query("practices_by_total", FUNDING.format(by="total"))
def practices_by_total(t: Tables) -> DataFrame:
    return an.ordered_practices(funded(t), "total").select("id", "place")


@query("practices_by_nrcs", FUNDING.format(by="nrcs"))
def practices_by_nrcs(t: Tables) -> DataFrame:
    return an.ordered_practices(funded(t), "nrcs").select("id", "place")


@query("practices_by_producer", FUNDING.format(by="producer"))
def practices_by_producer(t: Tables) -> DataFrame:
    return an.ordered_practices(funded(t), "producer").select("id", "place")


@query("id_filter", """SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000001')""")
def id_filter(t: Tables) -> DataFrame:
    return an.id_contains(t.customer, "c_name", "#00000001").select("c_custkey")


@query("phase_one_rows", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Cover Crops*' WHEN 1 THEN 'Education & Outreach' ELSE 'Project Management, Implementation, Coordination, Plan Revision' END AS name FROM supplier WHERE s_suppkey % 4 <> 3""")
def phase_one_rows(t: Tables) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 0, "Cover Crops*").when(F.col("s_suppkey") % 4 == 1, "Education & Outreach").when(F.col("s_suppkey") % 4 == 2, "Project Management, Implementation, Coordination, Plan Revision").otherwise("Cover Crops and more")
    return an.phase_one_only(t.supplier.select("s_suppkey", name.alias("name")))


@query("reextraction", """SELECT doc_id FROM documents WHERE length(text || ' ') = 600 OR (length(text) + 1 > 0 AND length(text) + 1 < 200 AND doc_id % 2 = 0)""")
def reextraction(t: Tables) -> DataFrame:
    named = t.documents.select("doc_id", F.concat(F.lit("plan"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("x"), F.col("doc_id").cast("string")).alias("id"), F.concat("text", F.lit(" ")).alias("text"))
    return an.reextraction_candidates(named, "id", "text", cut=600, short=200).select("doc_id")


@query("extraction_test", """WITH p AS (SELECT doc_id, len(string_split(text, 'the ')) - 1 AS n, length(text) > 3000 AS t FROM documents)
SELECT count(*)::BIGINT AS documents, count(*) FILTER (n > 0)::BIGINT AS with_practices, round(100.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 2) AS pct, round(sum(n)::DOUBLE / count(*), 2) AS avg_practices, count(*) FILTER (t)::BIGINT AS truncated FROM p""")  # fmt: skip
def extraction_test(t: Tables) -> DataFrame:
    practices = t.documents.select("doc_id", F.explode(F.slice(F.split("text", "the "), 2, 1 << 30)).alias("name"))
    return an.extraction_test(t.documents, practices, "doc_id", F.length("text") > 3000)


@query("item_jaccard", """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 7 AS x FROM lineitem WHERE l_quantity > 20), b AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 7 AS x FROM lineitem WHERE l_quantity <= 30),
j AS (SELECT coalesce(a.k, b.k) AS k, (a.k IS NOT NULL AND b.k IS NOT NULL)::INT AS c FROM a FULL JOIN b ON a.k = b.k AND a.x = b.x) SELECT k, sum(c)::BIGINT AS common, count(*)::BIGINT AS every, round(sum(c)::DOUBLE / count(*), 6) AS jaccard FROM j GROUP BY 1""")  # fmt: skip
def item_jaccard(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 7).alias("x"), "l_quantity")
    return an.jaccard(items.where("l_quantity > 20").drop("l_quantity"), items.where("l_quantity <= 30").drop("l_quantity"), "k", "x")


@query("gold_with_silver", """SELECT l.doc_id, d.source, l.quality, true AS found FROM labels l JOIN documents d USING (doc_id) WHERE d.lang = 'en' UNION ALL SELECT doc_id, NULL, NULL, false FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def gold_with_silver(t: Tables) -> DataFrame:
    """Gold labels with the documents of one language, and the gold ids that have none."""
    pairs, missing = an.matched_reports(t.labels.select("doc_id", "quality"), t.documents.where("lang = 'en'").select("doc_id", "source"), "doc_id")
    return pairs.select("doc_id", "source", "quality", F.lit(True).alias("found")).unionByName(missing.withColumn("found", F.lit(False)), allowMissingColumns=True)


@query("tables_with_normalized", """WITH n AS (SELECT l_orderkey, l_suppkey % 3 AS s, first(round(l_extendedprice, 2) ORDER BY l_linenumber, l_partkey, l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT o_orderkey, unnest([0, 1, 2]) AS s FROM orders) SELECT o_orderkey AS report, x.s::INTEGER AS tbl, v AS normalized_v FROM x LEFT JOIN n ON n.l_orderkey = x.o_orderkey AND n.s = x.s""")  # fmt: skip
def tables_with_normalized(t: Tables) -> DataFrame:
    tables = t.orders.select(F.col("o_orderkey").alias("report"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("tbl"))
    normalized = t.lineitem.select(F.col("l_orderkey").alias("report"), (F.col("l_suppkey") % 3).cast("int").alias("tbl"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"), F.round("l_extendedprice", 2).alias("v"))
    return an.normalized_of(tables, normalized, "report", "tbl").select("report", "tbl", "normalized_v")


STATE = """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'ok' END AS status, o_orderkey % 4 AS tries FROM orders WHERE o_orderkey % 3 = 0), w AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') """


def state(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(wanted, state) of a run over the orders."""
    known = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 == 0, "error").otherwise("ok").alias("status"), (F.col("o_orderkey") % 4).alias("tries"))
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")), known


@query("manifest_reconciliation", STATE + "SELECT k, 'open' AS what FROM w WHERE k NOT IN (SELECT k FROM s WHERE status = 'ok') UNION ALL SELECT k, 'stale' FROM s WHERE k NOT IN (SELECT k FROM w)")
def manifest_reconciliation(t: Tables) -> DataFrame:
    left, stale = inc.reconciled(*state(t), "k")
    return left.select("k", F.lit("open").alias("what")).unionByName(stale.select("k", F.lit("stale").alias("what")))


@query("errors_to_rerun", STATE + "SELECT k FROM s WHERE status = 'error' AND tries < 3")
def errors_to_rerun(t: Tables) -> DataFrame:
    return inc.to_rerun(state(t)[1]).select("k")


@query("without_output", STATE + "SELECT k FROM w WHERE k NOT IN (SELECT k FROM s)")
def without_output(t: Tables) -> DataFrame:
    wanted, known = state(t)
    return inc.without_output(wanted, known, "k")


def _first_parser(content: Column) -> Column:
    text = F.decode(content, "UTF-8")
    broken = F.length(text) % 3 == 0
    return F.struct(F.when(~broken, text).alias("text"), F.lit(1).alias("pages"), F.when(broken, F.lit("first failed")).alias("error"))


def _second_parser(content: Column) -> Column:
    text = F.decode(content, "UTF-8")
    broken = F.length(text) % 5 == 0
    return F.struct(F.when(~broken, F.concat(F.lit("2:"), text)).alias("text"), F.lit(2).alias("pages"), F.when(broken, F.lit("second failed")).alias("error"))


@query("parser_failover", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN n % 3 <> 0 THEN 1 WHEN n % 5 <> 0 THEN 2 END AS pages,
  CASE WHEN n % 3 = 0 AND n % 5 = 0 THEN 'first failed; second failed' WHEN trim(text) = '' AND n % 3 <> 0 THEN 'empty-text' END AS error FROM d""")  # fmt: skip
def parser_failover(t: Tables) -> DataFrame:
    """A second parser where the first fails; rows that both fail on go to quarantine with both errors."""
    files = t.documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    parsed, quarantined = src.parsed_or_quarantined(files, [_first_parser, _second_parser])
    return parsed.select("path", "pages", F.lit(None).cast("string").alias("error")).unionByName(quarantined.select("path", F.lit(None).cast("int").alias("pages"), "error"))


@query("ocr_needed", """SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0""")
def ocr_needed(t: Tables) -> DataFrame:
    runs = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, "parse: empty-text").when(F.col("o_orderkey") % 6 == 1, "timeout").alias("error"))
    return an.ocr_needed(runs).select("o_orderkey")


@query("bronze_written", """SELECT year(o_orderdate)::BIGINT AS y, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def bronze_written(t: Tables) -> DataFrame:
    """Documents appended in two writes, by day of ingest, and read back."""
    path = shared_path(t.spark, "bronze")
    for part in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"):
        sinks.write_bronze(t.orders.where(part).select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y")), path, F.make_date("y", F.lit(1), F.lit(1)))
    back = t.spark.read.schema("o_orderkey bigint, o_totalprice double, y int, ingest_date date").parquet(path)
    return back.groupBy(F.year("ingest_date").cast("long").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("silver_upsert", """SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE round(c_acctbal, 2) END::DOUBLE AS v, 2::BIGINT AS versions FROM customer""")
def silver_upsert(t: Tables) -> DataFrame:
    """A table written, then a tenth of its keys replaced: the new version is read, the one before stays."""
    path = shared_path(t.spark, "silver")
    rows = t.customer.select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 2).alias("v"))
    sinks.upsert(rows, path, "k")
    now = sinks.upsert(rows.where("k % 10 = 0").withColumn("v", F.lit(-1.0)), path, "k")
    return now.withColumn("versions", F.lit(len(sinks.versions(t.spark, path))).cast("long"))


@query("export_sheets", """SELECT 'Goals' AS sheet, (SELECT count(*) FROM supplier)::BIGINT AS n UNION ALL SELECT 'BMPs', (SELECT count(*) FROM part) UNION ALL SELECT 'Metadata', 2 UNION ALL SELECT 'Summary', 1 + (SELECT count(DISTINCT p_brand) FROM part)
UNION ALL SELECT x, 0 FROM (VALUES ('Implementation'), ('Monitoring'), ('Outreach'), ('Geography')) v(x)""")  # fmt: skip
def export_sheets(t: Tables) -> DataFrame:
    """The eight sheets of an export, by number of rows; categories become keys of the summary."""
    none = t.nation.limit(0).select(F.col("n_name").alias("id"))
    report = dict.fromkeys(("implementation", "monitoring", "outreach", "geography"), none)
    report |= {"goals": t.supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title")), "practices": t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))}
    by_brand = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    summary = by_brand.agg(F.sum("n").alias("practices"), F.map_from_entries(F.collect_list(F.struct("p_brand", "n"))).alias("categories"))
    metadata = t.spark.range(1).select(F.lit("r1").alias("id"), F.lit("plan.pdf").alias("file"))
    found = None
    for name, rows in sinks.sheets(report, metadata, summary).items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        found = part if found is None else found.unionByName(part)
    return found
