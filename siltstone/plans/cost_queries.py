"""Cost-table queries: lines are rendered from lineitem, parsed back and compared with plain sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.plans.registry import Tables, query

PATTERN = {p.id: p for p in ce.PATTERNS}


def usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def rendered(rows: DataFrame, key: str, head: list[Column | str], line: Column, tail: list[Column | str], order: str = "l_linenumber") -> DataFrame:
    """One document per key: head lines, one line per row, tail lines (which may aggregate)."""
    one = lambda x: F.lit(x) if isinstance(x, str) else x
    body = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    parts = F.concat(F.array(*[one(x) for x in head]), body, F.array(*[one(x) for x in tail])) if tail else F.concat(F.array(*[one(x) for x in head]), body)
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(parts, "\n").alias("text"))


def parsed(docs: DataFrame, pattern: str) -> DataFrame:
    return ce.tables_of(ce.document_lines(docs), PATTERN[pattern])


def totals(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "total_reported", "discrepancy")


SUMS = """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round({cost}, 2)), 2) AS total_computed,
  round({reported}, 2) AS total_reported, round(round({reported}, 2) - round(sum(round({cost}, 2)), 2), 2) + 0 AS discrepancy
FROM lineitem GROUP BY l_orderkey"""
PRICE = {"cost": "l_extendedprice", "reported": "sum(round(l_extendedprice, 2))"}


@query("booths_roundtrip", SUMS.format(**PRICE))
def booths_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("%d Part %d ea $%s %d $%s", "l_suppkey", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    return totals(parsed(docs, "booths_creek_bmps"))


@query("bell_creek_roundtrip", SUMS.format(cost="l_extendedprice", reported="max(round(l_extendedprice, 2))"))
def bell_creek_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d %d acres $%s/ac $%s", "l_partkey", F.col("l_quantity").cast("long"), F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Practice Area Affected BMP Cost BMP Total"], line, ["Total", usd(F.max("l_extendedprice"))])
    return totals(parsed(docs, "bell_creek_bmps"))


@query("phase1_roundtrip", SUMS.format(**PRICE))
def phase1_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d %d each $%s", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["BMPs Amount Estimated Cost"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    return totals(parsed(docs, "phase1_bmps"))


@query("nrcs_roundtrip", SUMS.format(**PRICE))
def nrcs_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d $%s  %d ft $%s", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Practice Average Unit NRCS Cost Units Total Cost"], line, [F.concat(F.lit("TOTAL "), usd(F.sum("l_extendedprice")))])
    return totals(parsed(docs, "practice_unit_nrcs_costs"))


@query("practice_costs_roundtrip", SUMS.format(**PRICE))
def practice_costs_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d\nnamed $%s %d $%s", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Practice", "Unit Cost w/Installation", "Number of Units Total Cost"], line, ["Total", usd(F.sum("l_extendedprice"))])
    return totals(parsed(docs, "practice_costs"))


@query("tech_assistance_roundtrip", SUMS.format(**PRICE))
def tech_assistance_roundtrip(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", ["Item Cost"], F.format_string("Part %d $%s", "l_partkey", F.format_number("l_extendedprice", 2)), [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    return totals(parsed(docs, "tech_assistance"))


@query("generic_activity_roundtrip", SUMS.format(**PRICE))
def generic_activity_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part named so %d each @ $%s $%s", F.col("l_quantity").cast("long"), F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Activity Size/Amount Estimated Cost"], line, [F.concat(F.lit("Total Estimated Project Cost "), usd(F.sum("l_extendedprice")))])
    return totals(parsed(docs, "generic_activity_costs"))


MATCHED = """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed,
  round(sum(round(l_tax * 1000 + 1, 2)), 2) AS match_computed, round(sum(round(l_extendedprice, 2)), 2) AS total_reported, round(sum(round(l_tax * 1000 + 1, 2)), 2) AS match_reported
FROM lineitem GROUP BY l_orderkey"""


def _matched(t: Tables, head: list, tail: str, pattern: str) -> DataFrame:
    match = F.round(F.col("l_tax") * 1000 + 1, 2)
    line = F.format_string("Part named so $%s $%s", F.format_number("l_extendedprice", 2), F.format_number(match, 2))
    docs = rendered(t.lineitem, "l_orderkey", head, line, [F.concat(F.lit("Total Estimated Project Cost "), usd(F.sum("l_extendedprice")), F.lit(tail), usd(F.sum(match)))])
    return parsed(docs, pattern).select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "match_computed", "total_reported", "match_reported")


@query("activity_match_roundtrip", MATCHED)
def activity_match_roundtrip(t: Tables) -> DataFrame:
    return _matched(t, ["Activity Size/Amount Estimated Cost Landowner Match"], " ", "activity_match")


@query("project_cost_block_roundtrip", MATCHED)
def project_cost_block_roundtrip(t: Tables) -> DataFrame:
    return _matched(t, ["Element C:"], " Match ", "total_estimated_project_cost_block")


FUNDING = """WITH p AS (SELECT l_orderkey AS doc_id, round(l_quantity * 10, 2) AS producer, (l_linenumber - 1) * 5.0::DOUBLE AS nrcs,
  round(l_extendedprice, 2) AS other FROM lineitem)
SELECT doc_id, round(sum(producer), 2) AS producer, round(sum(nrcs), 2) AS nrcs, round(sum(other), 2) AS other, round(sum(producer + nrcs + other), 2) AS total,
  round(round(sum(producer), 2) / round(sum(producer + nrcs + other), 2), 4) AS share_producer, round(round(sum(nrcs), 2) / round(sum(producer + nrcs + other), 2), 4) AS share_nrcs,
  round(round(sum(other), 2) / round(sum(producer + nrcs + other), 2), 4) AS share_other FROM p GROUP BY doc_id"""


@query("multi_funding_shares", FUNDING)
def multi_funding_shares(t: Tables) -> DataFrame:
    parts = [F.round(F.col("l_quantity") * 10, 2), (F.col("l_linenumber") - 1) * 5.0, F.round("l_extendedprice", 2)]
    spaced = [F.when(p == 0, F.lit("-")).otherwise(F.format_number(p, 2)) for p in parts]
    line = F.format_string("Part named so $ %s $ %s $ %s $ %s", *spaced, F.format_number(parts[0] + parts[1] + parts[2], 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Practice Producer NRCS EPA-MDEQ Total"], line, [F.concat(F.lit("Totals $ "), F.format_number(F.sum("l_extendedprice"), 2))])
    rows = ce.cost_rows(parsed(docs, "multi_funding_source_costs")).withColumnRenamed("total_cost", "total")
    return an.funding_allocation(rows, "doc_id")


@query("range_cost_midpoint", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum((round(l_extendedprice, 2) + round(l_extendedprice * 3, 2)) / 2), 2) AS total_computed,
  round((round(min(l_extendedprice), 2) + round(min(l_extendedprice) * 3, 2)) / 2, 2) AS total_reported FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def range_cost_midpoint(t: Tables) -> DataFrame:
    line = F.format_string("Part named so $2 - $4 %d ft $%s - $%s", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2), F.format_number(F.col("l_extendedprice") * 3, 2))
    tail = F.concat(F.lit("Total "), usd(F.min("l_extendedprice")), F.lit(" - "), usd(F.min("l_extendedprice") * 3))
    docs = rendered(t.lineitem, "l_orderkey", ["Practice Unit Cost Number of Units Total Cost"], line, [tail])
    only_head = parsed(docs, "practice_unit_cost_range").where("span_start = 0")
    return only_head.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "total_reported")


@query("activity_range_midpoint", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum((round(l_extendedprice, 2) + round(l_extendedprice * 3, 2)) / 2), 2) AS total_computed,
  round((round(min(l_extendedprice), 2) + round(min(l_extendedprice) * 3, 2)) / 2, 2) AS total_reported FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def activity_range_midpoint(t: Tables) -> DataFrame:
    line = F.format_string("Part named so $2 - $4 %d ft $%s - $%s", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2), F.format_number(F.col("l_extendedprice") * 3, 2))
    tail = F.concat(F.lit("TOTAL "), usd(F.min("l_extendedprice")), F.lit(" - "), usd(F.min("l_extendedprice") * 3))
    docs = rendered(t.lineitem, "l_orderkey", ["Activity Unit cost* Number of units Total cost"], line, [tail])
    only_head = parsed(docs, "activity_unit_cost_range").where("span_start = 0")
    return only_head.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "total_reported")


@query("coded_budget_merge", """WITH o AS (SELECT o_custkey AS doc_id, 'A' || substr(o_orderpriority, 1, 1) AS code, o_orderstatus AS section, round(o_totalprice, 2) AS p FROM orders)
SELECT doc_id, CASE section WHEN 'F' THEN 'I. Education' ELSE 'II. Structures' END AS section, code, round(sum(p), 2) AS total_cost FROM o GROUP BY ALL
HAVING doc_id IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 0)""")  # fmt: skip
def coded_budget_merge(t: Tables) -> DataFrame:
    """Each order is a small budget of its own; a customer's budgets are merged by code and section."""
    section = F.when(F.col("o_orderstatus") == "F", "I. Education").otherwise("II. Structures")
    block = F.concat_ws("\n", F.lit("Watershed Implementation Plan"), section, F.format_string("A%s. Order of the customer $%s", F.substring("o_orderpriority", 1, 1), F.format_number("o_totalprice", 2)), F.concat(F.lit("Subtotal: "), usd(F.col("o_totalprice"))), F.lit("VII. End"))
    docs = rendered(t.orders, "o_custkey", [], block, [], "o_orderkey")
    merged = ce.merge_coded_budgets(parsed(docs, "implementation_plan_coded_budget"))
    rows = merged.select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r.section", "r.code", "r.total_cost")
    # a customer with one order keeps its own table; either way one row per code and section
    return rows.groupBy("doc_id", "section", "code").agg(F.round(F.sum("total_cost"), 2).alias("total_cost"))


@query("coded_activity_roundtrip", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed,
  round(round(sum(round(l_extendedprice, 2)), 2) * 2, 2) AS total_reported FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5""")  # fmt: skip
def coded_activity_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("A%d. - Work on the part $%s", "l_linenumber", F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", [], line, [F.concat(F.lit("Subtotal: "), usd(F.sum("l_extendedprice")))])
    first = an.keep_best(parsed(docs, "coded_activity_budget_loose"), ["doc_id"], [F.col("span_start")])
    return first.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "total_reported")


@query("narrative_block_roundtrip", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4""")
def narrative_block_roundtrip(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", [], F.concat(F.lit("Work on the part "), usd(F.col("l_extendedprice"))), ["The end."])
    first = an.keep_best(parsed(docs, "narrative_cost_block"), ["doc_id"], [F.col("span_start")])
    return first.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed")


@query("sparse_costs_roundtrip", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 5""")
def sparse_costs_roundtrip(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", [], F.concat(F.lit("Prose in between.\nWork on the part: "), usd(F.col("l_extendedprice"))), [])
    first = an.keep_best(parsed(docs, "sparse_inline_costs"), ["doc_id"], [F.col("span_start")])
    return first.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed")


@query("adaptive_roundtrip", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""")
def adaptive_roundtrip(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", [], F.concat(F.lit("Work on it "), usd(F.col("l_extendedprice")), F.lit(" "), usd(F.col("l_quantity"))), [])
    first = an.keep_best(parsed(docs, "adaptive_generic_costs"), ["doc_id"], [F.col("span_start")])
    return first.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed")


@query("cost_tables_all_patterns", """WITH l AS (SELECT l_orderkey AS k, l_quantity AS q, CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS p, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_suppkey || ' Part ' || l_partkey || ' ea $' || format('{:,.2f}', l_extendedprice / l_quantity) || ' ' || l_quantity::BIGINT || ' $' || format('{:,.2f}', l_extendedprice)) AS i FROM lineitem),
  paid AS (SELECT k, i, n, p FROM l UNION ALL SELECT k, n + 1, n, sum(p) FROM l GROUP BY k, n),
  block AS (SELECT i, n, sum(p) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS s FROM paid),
  range AS (SELECT q, count(*) FILTER (q >= 10) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS c, sum(p) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 119 FOLLOWING) AS s,
    count(*) FILTER (q >= 10) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS d, sum(p) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 99 FOLLOWING) AS t FROM l)
SELECT 'booths_creek_bmps' AS pattern_id, count(DISTINCT k)::BIGINT AS tables, sum(p)::DOUBLE AS total FROM l
UNION ALL SELECT 'narrative_cost_block', count(*), sum(s)::DOUBLE FROM block WHERE i <= n - 2 HAVING count(*) > 0
UNION ALL SELECT 'practice_unit_cost_range', count(*), sum(s)::DOUBLE FROM range WHERE q >= 10 AND c >= 2 HAVING count(*) > 0
UNION ALL SELECT 'activity_unit_cost_range', count(*), sum(t)::DOUBLE FROM range WHERE q >= 10 AND d >= 2 HAVING count(*) > 0""")  # fmt: skip
def cost_tables_all_patterns(t: Tables) -> DataFrame:
    """The whole registry over documents with one explicit table each: blocks and ranges are found in its lines too; adaptive blocks are covered and go."""
    line = F.format_string("%d Part %d ea $%s %d $%s", "l_suppkey", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    tables = ce.cost_tables(ce.document_lines(docs))
    return tables.groupBy("pattern_id").agg(F.count("*").alias("tables"), F.sum(F.col("total_computed").cast("decimal(18, 2)")).cast("double").alias("total"))
