"""Queries of the whole way from text to report, over plans rendered from the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import cost_engine as ce
from siltstone.operators import cost_legacy as cl
from siltstone.operators import entities as en
from siltstone.plans import report
from siltstone.plans.cost_queries import rendered, usd
from siltstone.plans.registry import Tables, query

#: The kinds of plans, by customer number modulo five: a plain one; one whose text has the
#: ultimate goal; one with a goal outside of any goal section; one with an objective; one
#: whose goal breaks off.
KINDS = 5


def plans(t: Tables) -> DataFrame:
    """(doc_id, text): one plan per customer."""
    n = F.col("c_custkey").cast("int")
    goal = F.when(n % KINDS == 0, F.format_string("Goals:\nThe goal is to reduce sediment by %d percent and cut %d lbs to %d lbs by %d, lead: Clerk %d.", n % 90 + 5, n % 50 + 100, n % 40 + 10, n % 30 + 2030, n % 100))
    goal = goal.when(n % KINDS == 1, F.format_string("Goals\nNone yet\nGeography\nThe ultimate goal is to bring about cleaner water for %d people in the\nwatershed. More on that later.", n))
    goal = goal.when(n % KINDS == 2, F.format_string("Monitoring\nGoal: reduce nitrogen loads by %d percent before the year 2030 in all streams", n % 90 + 5))
    goal = goal.when(n % KINDS == 3, F.format_string("Goals\nThe goal and objective is to lower phosphorus in %d streams of the county.", n))
    goal = goal.otherwise(F.format_string("Goals\nThe ultimate goal is to bring about behavior changes and the use of\nOutreach\nbest management practices that will improve water for %d people.", n))
    listed = F.when(n % KINDS == 2, "These BMPs include the following:\nRain Garden\nFilter Strip\nTotal\n").otherwise("")
    own = F.format_string("Install %d acres of riparian buffer", n % 90 + 1)
    practices = F.when(n % KINDS == 0, F.concat(F.lit("BMPs\n"), own, F.format_string("\nBudget 2011\nFencing %s ft @ $2.50\n", F.format_number(n % 900 + 1000, 0))))
    practices = practices.when(n % KINDS == 1, F.concat(F.lit("BMPs\n"), own, F.format_string("\nMonitoring\nAg BMP $%s\n", F.format_number(n + 1000, 0)))).otherwise("")
    acts = F.format_string("Implementation\nMonitor stream quarterly, lead: Soil District, $5,000 in %d\nNothing else\n", n % 20 + 2025)
    return t.customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Introduction to the plan\n"), listed, practices, acts, goal, F.lit("\n")).alias("text"))


@query("process_goals", """SELECT c_custkey AS doc_id, 'G1' AS id,
  CASE c_custkey % 5 WHEN 0 THEN 'The goal is to reduce sediment by ' || (c_custkey % 90 + 5) || ' percent and cut ' || (c_custkey % 50 + 100) || ' lbs to ' || (c_custkey % 40 + 10) || ' lbs by ' || (c_custkey % 30 + 2030) || ', lead: Clerk ' || (c_custkey % 100) || '.'
    WHEN 1 THEN 'The ultimate goal is to bring about cleaner water for ' || c_custkey || ' people in the watershed.'
    WHEN 2 THEN 'reduce nitrogen loads by ' || (c_custkey % 90 + 5) || ' percent before the year 2030 in all streams'
    WHEN 3 THEN 'The goal and objective is to lower phosphorus in ' || c_custkey || ' streams of the county.'
    ELSE 'The ultimate goal is to bring about behavior changes and the use of Monitor stream quarterly, lead: Soil District, $5,000 in ' || (c_custkey % 20 + 2025) || ' Nothing else best management practices that will improve water for ' || c_custkey || ' people.' END AS title,
  CASE c_custkey % 5 WHEN 2 THEN 0.45 WHEN 3 THEN 0.40 WHEN 4 THEN 0.80 ELSE 0.95 END::DOUBLE AS confidence,
  CASE c_custkey % 5 WHEN 0 THEN 'explicit_phrase' WHEN 1 THEN 'bronze_direct_slice' WHEN 2 THEN 'top_scoring' WHEN 3 THEN 'canonical_phrase' ELSE 'simple_stream_capture' END AS primary_reason,
  c_custkey % 5 = 2 AS fallback, true AS is_primary FROM customer""")  # fmt: skip
def process_goals(t: Tables) -> DataFrame:
    """The known sentence, the broken one, admission, the objective and the fallbacks: each plan takes one of these ways."""
    goals = report.report_goals(report.sectioned(plans(t)))
    return goals.select("doc_id", "id", "title", F.round("confidence", 6).alias("confidence"), "primary_reason", "fallback", "is_primary")


@query("process_practices", """WITH c AS (SELECT c_custkey AS n FROM customer)
SELECT n AS doc_id, 'B1' AS id, 'Install' AS name, 'Vegetative Buffer' AS category, 0.8::DOUBLE AS confidence, 'Install ' || (n % 90 + 1) || ' acres of riparian buffer' AS original_name FROM c WHERE n % 5 IN (0, 1)
UNION ALL SELECT n, 'B2', 'Fencing', 'Livestock Exclusion', 0.65 + CASE WHEN regexp_matches(format('{:,}', n % 900 + 1000), '[0-9]{4}') THEN 0.05 ELSE 0 END, 'Fencing ' || format('{:,}', n % 900 + 1000) || ' ft @ $2.50' FROM c WHERE n % 5 = 0
UNION ALL SELECT n, 'B2', 'Ag BMP', 'Agriculture', 0.25, NULL FROM c WHERE n % 5 = 1
UNION ALL SELECT n, 'B1', 'Rain Garden', 'General', 0.22, NULL FROM c WHERE n % 5 = 2 UNION ALL SELECT n, 'B2', 'Filter Strip', 'General', 0.22, NULL FROM c WHERE n % 5 = 2""")  # fmt: skip
def process_practices(t: Tables) -> DataFrame:
    """Section lines, summary lines where few, the noise filter, cost tails, the raw list; numbered in the end."""
    kept, _ = report.report_practices(report.sectioned(plans(t)), None)
    return kept.select("doc_id", "id", "name", "category", F.round("confidence", 6).alias("confidence"), "original_name")


@query("process_rejected", """SELECT c_custkey AS doc_id, 'Budget 2011' AS name, 'starts_bad_token' AS primary_reason, 2::BIGINT AS reasons FROM customer WHERE c_custkey % 5 = 0""")
def process_rejected(t: Tables) -> DataFrame:
    """What the noise filter of a processed plan rejects, and why."""
    _, rejected = report.report_practices(report.sectioned(plans(t)), None)
    return rejected.select("doc_id", "name", F.col("reject_primary").alias("primary_reason"), F.size("reject_reasons").cast("long").alias("reasons"))


@query("process_injected_rows", """WITH l AS (SELECT l_orderkey AS doc_id, l_partkey, l_linenumber FROM lineitem), f AS (SELECT doc_id, l_partkey, min(l_linenumber) AS n FROM l GROUP BY ALL)
SELECT doc_id, 'Part ' || l_partkey AS name, 0.32::DOUBLE AS confidence FROM f UNION ALL SELECT o_orderkey, 'Monitor the stream', 0.2 FROM orders""")  # fmt: skip
def process_injected_rows(t: Tables) -> DataFrame:
    """Practices of cost rows, behind the section's own; administration and heads are left out."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit("p").alias("pattern_id"), F.col("l_linenumber").cast("int").alias("place"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit("*")).alias("name"))
    heads = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("p").alias("pattern_id"), F.lit(0).alias("place"), F.explode(F.array(F.lit("Total"), F.lit("BMPs*"), F.lit("Technical Assistance"), F.lit("monitor the stream"))).alias("name"))
    known = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.lit("Monitor the stream").alias("name"), F.lit("General").alias("category"), F.lit(0.2).alias("confidence"), F.lit("line").alias("source"))
    return en.injected_cost_rows(rows.unionByName(heads), known).select("doc_id", "name", "confidence")


@query("process_tables", """SELECT 'booths_creek_bmps' AS pattern_id, count(DISTINCT l_orderkey)::BIGINT AS tables, round(sum(round(l_extendedprice, 2)), 2) AS total FROM lineitem
UNION ALL SELECT 'booths_creek_format', count(DISTINCT l_orderkey), round(sum(round(l_extendedprice, 2)), 2) FROM lineitem""")  # fmt: skip
def process_tables(t: Tables) -> DataFrame:
    """All patterns and older kinds over one explicit table per order: adaptive blocks are covered, and the older kind has the table under a title of its own."""
    line = F.format_string("%d Part %d ea $%s %d $%s", "l_suppkey", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["BMPs", "Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    tables = report.report_tables(report.sectioned(docs))
    asked = tables.where(F.col("pattern_id").isin("booths_creek_bmps", "booths_creek_format", "adaptive_generic_costs"))
    return asked.groupBy("pattern_id").agg(F.count("*").alias("tables"), F.round(F.sum("total_computed"), 2).alias("total"))


@query("process_primary_table", """SELECT l_orderkey AS doc_id, 'booths_creek_bmps' AS pattern_id, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY l_orderkey""")
def process_primary_table(t: Tables) -> DataFrame:
    """The one table that stands for a document: the first, where no full-project estimate is."""
    line = F.format_string("%d Part %d ea $%s %d $%s", "l_suppkey", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    tables = ce.cost_tables(ce.document_lines(docs), [p for p in ce.PATTERNS if p.id in ("booths_creek_bmps", "phase1_bmps")])
    return cl.primary_table(tables).select("doc_id", "pattern_id", F.size("rows").cast("long").alias("n_rows"))


@query("process_summary", """SELECT c_custkey AS doc_id, 1::BIGINT AS goals, CASE c_custkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS practices, 1::BIGINT AS activities,
  CASE WHEN c_custkey % 5 IN (0, 2, 3) THEN 1 ELSE 0 END::BIGINT AS goals_present, CASE WHEN c_custkey % 5 <= 2 THEN 2 ELSE 0 END::BIGINT AS practices_present, 1::BIGINT AS implementation_present,
  CASE WHEN c_custkey % 5 IN (1, 2) THEN 1 ELSE 0 END::BIGINT AS monitoring_present, CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 0 END::BIGINT AS outreach_present FROM customer""")  # fmt: skip
def process_summary(t: Tables) -> DataFrame:
    """The whole process: entities counted, and how many of them stand in the text."""
    whole = report.summary(report.process(plans(t)))
    return whole.select("doc_id", F.col("total").alias("goals"), "practices", "activities", *[f"{e}_present" for e, _ in report.PRESENCE])


@query("process_enriched", """SELECT l_orderkey AS doc_id, 1::BIGINT AS clusters, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total FROM lineitem
GROUP BY l_orderkey HAVING count(*) >= 3 AND sum(round(l_extendedprice, 2)) >= 5000 AND count(DISTINCT round(l_extendedprice, 2)) >= 2
AND max((SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey GROUP BY x.l_linenumber))) <= 0.6 * count(*)""")  # fmt: skip
def process_enriched(t: Tables) -> DataFrame:
    """Loose clusters of documents that the patterns give no table, as the last pass adds them."""
    docs = rendered(t.lineitem, "l_orderkey", ["Prose."], F.concat(F.lit("Part "), F.col("l_linenumber").cast("string"), F.lit("\t"), usd(F.col("l_extendedprice"))), ["The end."])
    none = ce.cost_tables(ce.document_lines(docs), [p for p in ce.PATTERNS if p.id == "booths_creek_bmps"])
    found = cl.enrich(docs, none).where("table_id LIKE 'aggressive_cluster_%'")
    return found.groupBy("doc_id").agg(F.count("*").alias("clusters"), F.sum(F.size("rows")).cast("long").alias("n_rows"), F.round(F.sum("total_computed"), 2).alias("total"))
