"""Further queries: older cost tables, clusters, row display and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.operators import cost_legacy as cl
from siltstone.operators import lines as ln
from siltstone.plans.cost_queries import SUMS, rendered, totals, usd
from siltstone.plans.registry import Tables, query

LEGACY = {p.id: p for p in cl.LEGACY}
PRICE = {"cost": "l_extendedprice", "reported": "sum(round(l_extendedprice, 2))"}


def legacy(docs: DataFrame, pattern: str) -> DataFrame:
    return totals(ce.tables_of(ce.document_lines(docs), LEGACY[pattern]))


@query("full_project_roundtrip", """WITH l AS (SELECT l_orderkey, l_partkey, first(round(l_extendedprice, 2) ORDER BY l_linenumber, l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(p), 2) AS total_computed, round(sum(p), 2) AS total_reported, 0.0::DOUBLE AS discrepancy FROM l GROUP BY 1""")  # fmt: skip
def full_project_roundtrip(t: Tables) -> DataFrame:
    """Named estimates with sizes; names that repeat count once."""
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min_by(F.round("l_extendedprice", 2), F.struct("l_linenumber", "l_extendedprice")).alias("p"), F.lit(1).alias("l_linenumber"))
    letters = F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij")
    line = F.concat(F.lit("Part "), letters, F.lit(" 3 each @ $2.50 "), usd(F.col("p")), F.lit("\nPART "), letters, F.lit(" 3 each $9.00"))
    docs = rendered(rows, "l_orderkey", ["Cost Estimate: Full Project Implementation", "BMPs* Size/Amount Estimated Cost"], line, [F.concat(F.lit("Total Estimated Cost "), usd(F.sum("p")))])
    return legacy(docs, "full_project_estimate")


@query("booths_format_roundtrip", SUMS.format(**PRICE))
def booths_format_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("%d Part %d ea $1.00 %d $%s", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    return legacy(rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))]), "booths_creek_format")


@query("bell_format_roundtrip", SUMS.format(**PRICE))
def bell_format_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d %d acres $1.00/ac $%s", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    return legacy(rendered(t.lineitem, "l_orderkey", ["Practice Area Affected BMP Cost BMP Total"], line, ["Total", usd(F.sum("l_extendedprice"))]), "bell_creek_format")


@query("phase1_format_roundtrip", SUMS.format(**PRICE))
def phase1_format_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d %d each $%s", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    return legacy(rendered(t.lineitem, "l_orderkey", ["BMPs Amount Estimated Cost"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))]), "phase1_bmps_format")


@query("tech_format_roundtrip", SUMS.format(**PRICE))
def tech_format_roundtrip(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", ["Table 3 Technical Assistance", "Item Cost"], F.format_string("Part %d $%s", "l_partkey", F.format_number("l_extendedprice", 2)), [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    return legacy(docs, "tech_assistance_format")


@query("practice_format_roundtrip", SUMS.format(**PRICE))
def practice_format_roundtrip(t: Tables) -> DataFrame:
    line = F.format_string("Part %d $1.00 %d $%s", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    return legacy(rendered(t.lineitem, "l_orderkey", ["Practice", "Unit Cost w/Installation", "Number of Units Total Cost"], line, ["Total", usd(F.sum("l_extendedprice"))]), "practice_costs_format")


@query("known_practice_roundtrip", """SELECT l_orderkey AS doc_id, count(*)::BIGINT AS n_rows, round(sum(round(l_extendedprice, 2)), 2) AS total_computed, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def known_practice_roundtrip(t: Tables) -> DataFrame:
    name = F.when(F.col("l_returnflag") == "R", "Fencing").otherwise("Unheard of")
    line = F.concat(name, F.lit(" "), F.format_number("l_quantity", 0), F.lit(" ft @ $2.50/ft "), usd(F.col("l_extendedprice")), F.lit(" $1"))
    docs = rendered(t.lineitem, "l_orderkey", ["Activity Size/Amount Estimated Cost Landowner Match"], line, [])
    found = ce.tables_of(ce.document_lines(docs), LEGACY["activity_match_format"])
    return found.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", ce.total_of(F.col("rows"), "quantity").alias("quantity"))


@query("loose_cluster_roundtrip", """WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT round(l_extendedprice, 2)) AS d, round(sum(round(l_extendedprice, 2)), 2) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey AS doc_id, n::BIGINT AS n_rows, s AS total_computed, s AS total_reported, 0.6::DOUBLE AS confidence FROM l WHERE n >= 3 AND d >= 2 AND s >= 5000""")  # fmt: skip
def loose_cluster_roundtrip(t: Tables) -> DataFrame:
    """Runs of amount lines with cells; the total stands behind a blank line."""
    rank = F.row_number().over(an.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    line = F.concat(F.lit("Item "), F.col("r").cast("string"), F.lit("  10 ft  "), usd(F.col("l_extendedprice")))
    docs = rendered(t.lineitem.withColumn("r", rank), "l_orderkey", ["Estimated budget"], line, ["", F.concat(F.lit("All in all, total "), usd(F.sum("l_extendedprice")))])
    found = cl.loose_clusters(ce.document_lines(docs, keep_blank=True))
    return found.select("doc_id", F.size("rows").cast("long").alias("n_rows"), "total_computed", "total_reported", F.col("pattern_confidence").alias("confidence"))


@query("cluster_signatures", """SELECT l_orderkey AS doc_id, 2 AS "start", count(*)::INTEGER + 1 AS "end", count(*)::INTEGER AS money_lines FROM lineitem GROUP BY 1 HAVING count(*) >= 4""")
def cluster_signatures(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", ["Plan"], F.concat(F.lit("Work "), usd(F.col("l_extendedprice"))), ["prose"])
    return cl.cluster_signatures(ce.document_lines(docs)).select("doc_id", "start", "end", "money_lines")


@query("narrative_blocks", """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey AS doc_id, n::BIGINT AS bmps, 1::BIGINT AS goals FROM l""")
def narrative_blocks(t: Tables) -> DataFrame:
    docs = rendered(t.lineitem, "l_orderkey", ["The goal of it"], F.concat(F.lit("Work "), F.col("l_linenumber").cast("string"), F.lit(" "), usd(F.col("l_extendedprice"))), [])
    found = ln.narrative_blocks(docs, "doc_id", "text")
    return found.groupBy("doc_id").agg(an.count_if(F.col("section") == "BMPs").alias("bmps"), an.count_if(F.col("section") == "Goals").alias("goals"))


@query("goal_starters", """SELECT p_partkey, 'The goal is ' || p_name AS description FROM part""")
def goal_starters(t: Tables) -> DataFrame:
    long = F.concat(F.lit("as, The goal is "), "p_name")
    return t.part.select("p_partkey", tx.from_starter(F.when(F.col("p_partkey") % 2 == 0, long).otherwise(F.concat(F.repeat(F.lit("x "), 90), F.lit("The goal is "), "p_name"))).alias("d")).select("p_partkey", F.regexp_replace("d", "^the goal", "The goal").alias("description"))


@query("row_descriptors", """SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE p_size END::DOUBLE AS quantity, CASE WHEN p_partkey % 4 < 2 THEN 'ft' END AS unit, CASE WHEN p_partkey % 4 = 0 THEN 2.5 END::DOUBLE AS rate, ['high', 'medium', 'low', 'none'][p_partkey % 4 + 1] AS confidence FROM part""")
def row_descriptors(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(n, F.lit(" ft @ $2.50/ft"))).when(F.col("p_partkey") % 4 == 1, F.concat(n, F.lit(" ft of it"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("about "), n)).otherwise(F.lit("none"))
    d = tx.descriptor(text)
    return t.part.select("p_partkey", d["quantity"].alias("quantity"), d["unit"].alias("unit"), d["rate"].alias("rate"), d["confidence"].alias("confidence"))


@query("cost_fields", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS amount FROM lineitem""")
def cost_fields(t: Tables) -> DataFrame:
    """Rows with columns of any name: the amount is found by priority."""
    other = F.create_map(F.lit("Units"), F.lit("4"), F.lit("Unit Cost"), F.lit("$1"), F.lit("Total Cost"), usd(F.col("l_extendedprice")))
    odd = F.create_map(F.lit("Name"), F.lit("x 5"), F.lit("NRCS price"), usd(F.col("l_extendedprice")))
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.cost_field(F.when(F.col("l_linenumber") % 2 == 0, other).otherwise(odd)).alias("amount"))


@query("metric_parse", """SELECT p_partkey, p_size::DOUBLE AS value, 'acres' AS unit, 'buffers of ' || p_name AS label FROM part""")
def metric_parse(t: Tables) -> DataFrame:
    m = tx.metric(F.concat(F.col("p_size").cast("string"), F.lit(" Acres: buffers of "), "p_name"))
    return t.part.select("p_partkey", m["value"].alias("value"), m["unit"].alias("unit"), m["label"].alias("label"))


@query("collapsed_rows", """SELECT l_orderkey, l_returnflag, count(*)::BIGINT AS n, sum(DISTINCT round(l_quantity, 0)) AS cost FROM lineitem GROUP BY 1, 2""")
def collapsed_rows(t: Tables) -> DataFrame:
    return an.collapsed_rows(t.lineitem, ["l_orderkey", "l_returnflag"], "l_quantity")


@query("display_filter", """SELECT p_partkey FROM part WHERE p_name LIKE 'c%' OR (p_size > 40 AND p_brand IS NOT NULL) OR p_retailprice > 1500""")
def display_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").startswith("c") | ((F.col("p_size") > 40) & F.col("p_brand").isNotNull()) | (F.col("p_retailprice") > 1500)).select("p_partkey")


@query("newest_sessions", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 12""")
def newest_sessions(t: Tables) -> DataFrame:
    return an.newest_sessions(t.events, "user_id", "ts", "event_id").select("user_id", "event_id")


@query("scan_scores", r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents),
s AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)cost|budget')) AS heads, count(*) FILTER (regexp_matches(line, '\$[0-9]')) AS amounts, count(*) FILTER (regexp_matches(line, '(?i)bmp|practice|activity')) AS cues FROM l GROUP BY 1)
SELECT doc_id, heads::BIGINT AS heads, amounts::BIGINT AS amounts, cues::BIGINT AS cues, (heads * 5 + amounts * 2 + cues)::BIGINT AS score FROM s ORDER BY score DESC, doc_id LIMIT 25""")  # fmt: skip
def scan_scores(t: Tables) -> DataFrame:
    return an.scan_scores(ln.explode_lines(t.documents, "doc_id", "text"), "doc_id", "line")


@query("multipart_anomalies", """WITH p AS (SELECT source AS base, length(text) AS n FROM documents) SELECT base, count(*)::BIGINT AS parts, min(n)::BIGINT AS smallest, max(n)::BIGINT AS largest FROM p GROUP BY 1 HAVING count(*) > 1 AND (max(n) > 25 * min(n) OR min(n) < 200)""")
def multipart_anomalies(t: Tables) -> DataFrame:
    parts = t.documents.select(F.col("source").alias("base"), F.length("text").cast("long").alias("n"))
    return an.multipart_anomalies(parts, "base", "n")


@query("non_overlapping_tables", """SELECT l_orderkey AS doc_id, 'booths_creek_bmps' AS pattern_id, round(sum(round(l_extendedprice, 2)), 2) AS total FROM lineitem GROUP BY 1""")
def non_overlapping_tables(t: Tables) -> DataFrame:
    """Several patterns find the same lines; each line counts once, for the most confident."""
    line = F.format_string("%d Part %d ea $1.00 %d $%s", "l_suppkey", "l_partkey", F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    patterns = [p for p in ce.PATTERNS if p.id in ("booths_creek_bmps", "adaptive_generic_costs", "narrative_cost_block")]
    kept = ce.cost_tables(ce.document_lines(docs), patterns, keep_covered=True, apart=True)
    return kept.select("doc_id", "pattern_id", F.col("total_computed").alias("total"))
