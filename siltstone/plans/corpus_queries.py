"""Corpus analytics over the star schema: orders stand for reports, lineitems for their cost rows, parts for practices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_name
from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.operators import entities as en
from siltstone.operators import lines as ln
from siltstone.plans.cost_queries import PATTERN, rendered, usd
from siltstone.plans.registry import Tables, query


def report_tables(t: Tables) -> DataFrame:
    """(report_id, pattern_id, confidence, reported, computed): an order reports its price, its lineitems add up to another."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("computed"), F.round(F.max("l_discount") * 10, 2).alias("confidence"))
    return t.orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("report_id"), F.col("o_orderpriority").alias("pattern_id"), "confidence", F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice", 2)).alias("reported"), "computed")


TABLES = """WITH rows AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS computed, round(max(l_discount) * 10, 2) AS confidence FROM lineitem GROUP BY 1),
t AS (SELECT o_custkey AS report_id, o_orderpriority AS pattern_id, confidence, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS reported, computed
  FROM orders JOIN rows ON o_orderkey = l_orderkey)
"""


@query("pattern_usage_of_parsed_tables", """WITH t AS (SELECT l_orderkey, round(sum(round(l_extendedprice, 2)), 2) AS c FROM lineitem GROUP BY 1)
SELECT 'booths_creek_bmps' AS pattern_id, count(*)::BIGINT AS table_count, round(sum(c), 2) AS total_reported, round(sum(c), 2) AS total_computed, round(sum(c * 0.95), 0) AS weighted_total,
  count(*)::BIGINT AS with_reported, count(*)::BIGINT AS total_with_both, 1.0::DOUBLE AS within_1, 1.0::DOUBLE AS within_5, 0.0::DOUBLE AS avg_discrepancy FROM t""")  # fmt: skip
def pattern_usage_of_parsed_tables(t: Tables) -> DataFrame:
    """End to end: render cost lines, find and parse the tables, sum by pattern."""
    line = F.format_string("%d Part %d ea $%s %d $%s", "l_suppkey", "l_partkey", F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2), F.col("l_quantity").cast("long"), F.format_number("l_extendedprice", 2))
    docs = rendered(t.lineitem, "l_orderkey", ["Code Practice Units Cost Estimated Units Total"], line, [F.concat(F.lit("Total "), usd(F.sum("l_extendedprice")))])
    found = ce.tables_of(ce.document_lines(docs), PATTERN["booths_creek_bmps"])
    usage = an.pattern_usage(found.select(F.col("doc_id").alias("report_id"), "pattern_id", F.col("pattern_confidence").alias("confidence"), F.col("total_reported").alias("reported"), F.col("total_computed").alias("computed")))
    return usage.withColumn("weighted_total", F.round("weighted_total", 0))


@query("pattern_usage", TABLES + """SELECT pattern_id, count(*)::BIGINT AS table_count, round(sum(CASE WHEN reported > 0 THEN reported ELSE 0 END), 2) AS total_reported, round(sum(computed), 2) AS total_computed,
  round(sum(computed * least(confidence, 1.0)), 2) AS weighted_total, count(reported)::BIGINT AS with_reported, count(reported)::BIGINT AS total_with_both,
  round(count(*) FILTER (abs(reported - computed) / computed <= 0.01) / count(reported), 6) AS within_1, round(count(*) FILTER (abs(reported - computed) / computed <= 0.05) / count(reported), 6) AS within_5,
  round(avg(reported - computed), 2) AS avg_discrepancy FROM t GROUP BY 1""")  # fmt: skip
def pattern_usage(t: Tables) -> DataFrame:
    return an.pattern_usage(report_tables(t))


@query("cost_summary_flags", TABLES + """, d AS (SELECT report_id, sum(CASE WHEN reported > 0 THEN reported ELSE 0 END) AS r, sum(computed) AS c, sum(computed * least(confidence, 1.0)) AS w FROM t GROUP BY 1)
SELECT count(*)::BIGINT AS report_count, count(*) FILTER (r > 0 OR c > 0)::BIGINT AS reports_with_costs, round(sum(r), 2) AS total_reported, round(sum(c), 2) AS total_computed, round(sum(r) - sum(c), 2) AS discrepancy,
  round(sum(w), 2) AS weighted_total, count(*) FILTER (r > 0 AND c > 0 AND abs(r - c) / c > 0.01)::BIGINT AS discrepancy_flags FROM d""")  # fmt: skip
def cost_summary_flags(t: Tables) -> DataFrame:
    return an.cost_summary(report_tables(t))


@query("report_list", TABLES + """SELECT report_id, nullif(round(sum(CASE WHEN reported > 0 THEN reported ELSE 0 END), 2), 0) AS total_reported, nullif(round(sum(computed), 2), 0) AS total_computed,
  CASE WHEN sum(CASE WHEN reported > 0 THEN reported ELSE 0 END) <> 0 AND sum(computed) <> 0 THEN round(round(sum(CASE WHEN reported > 0 THEN reported ELSE 0 END), 2) - round(sum(computed), 2), 2) END AS discrepancy,
  count(*)::BIGINT AS table_count, count(DISTINCT pattern_id)::BIGINT AS pattern_count FROM t GROUP BY 1""")  # fmt: skip
def report_list(t: Tables) -> DataFrame:
    return an.report_list(report_tables(t))


@query("pattern_totals", TABLES + """SELECT coalesce(pattern_id, '*') AS pattern_id, count(*)::BIGINT AS table_count, round(sum(reported), 2) AS total_reported, round(sum(computed), 2) AS total_computed FROM t GROUP BY ROLLUP (pattern_id)""")
def pattern_totals(t: Tables) -> DataFrame:
    return an.pattern_totals(report_tables(t))


@query("verify_totals", TABLES + """SELECT report_id, pattern_id, round(reported / nullif(computed, 0), 6) AS ratio,
  CASE WHEN reported IS NULL THEN 'skipped' WHEN coalesce(computed, 0) = 0 THEN 'failed' WHEN reported / computed BETWEEN 1 / 1.05::DOUBLE AND 1.05::DOUBLE THEN 'ok' ELSE 'failed' END AS verdict FROM t""")  # fmt: skip
def verify_totals(t: Tables) -> DataFrame:
    return an.verify_totals(report_tables(t))


@query("discrepancy_buckets", TABLES + """SELECT pattern_id, count(*)::BIGINT AS tables, count(DISTINCT report_id)::BIGINT AS reports, count(*) FILTER (abs(reported - computed) / nullif(reported, 0) <= 0.01)::BIGINT AS within_1,
  count(*) FILTER (abs(reported - computed) / nullif(reported, 0) <= 0.05)::BIGINT AS within_5, count(*) FILTER (abs(reported - computed) / nullif(reported, 0) > 0.2)::BIGINT AS over_20 FROM t GROUP BY 1""")  # fmt: skip
def discrepancy_buckets(t: Tables) -> DataFrame:
    return an.discrepancy_buckets(report_tables(t))


@query("pattern_regression", TABLES + """SELECT pattern_id, count(*) FILTER (coalesce(computed, 0) <= 0)::BIGINT AS non_positive, count(*) FILTER (abs(reported / nullif(computed, 0) - 1) > 0.1)::BIGINT AS off_by_10 FROM t GROUP BY 1""")
def pattern_regression(t: Tables) -> DataFrame:
    ratio = F.col("reported") / F.nullif(F.col("computed"), F.lit(0.0))
    return report_tables(t).groupBy("pattern_id").agg(an.count_if(F.coalesce("computed", F.lit(0.0)) <= 0).alias("non_positive"), an.count_if(F.abs(ratio - 1) > 0.1).alias("off_by_10"))


@query("coverage_by_layer", """WITH b AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders), l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
c AS (SELECT count(*) AS base, count(o.k) AS o, count(l.k) AS l FROM b LEFT JOIN o USING (k) LEFT JOIN l USING (k))
SELECT 'bronze' AS layer, o::BIGINT AS n, base::BIGINT AS base, round(100.0 * o::DOUBLE / base, 1) AS pct, (base - o)::BIGINT AS missing FROM c UNION ALL SELECT 'silver', l::BIGINT, base::BIGINT, round(100.0 * l::DOUBLE / base, 1), (base - l)::BIGINT FROM c""")  # fmt: skip
def coverage_by_layer(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey")
    returned = orders.join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return an.layer_coverage(t.customer.select(F.col("c_custkey").alias("k")), {"bronze": orders, "silver": returned}, "k")


@query("prefix_semi_join", """WITH a AS (SELECT DISTINCT p_name AS n FROM part WHERE length(p_name) >= 3), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || left(split_part(p_name, ' ', 2), 2) AS n FROM part)
SELECT n AS name FROM a WHERE EXISTS (SELECT 1 FROM b WHERE length(b.n) >= 3 AND (starts_with(a.n, b.n) OR starts_with(b.n, a.n)))""")  # fmt: skip
def prefix_semi_join(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    short = t.part.select(F.concat_ws(" ", words[0], F.substring(F.get(words, F.lit(1)), 1, 2)).alias("b"))
    return an.mutual_prefix(t.part.select(F.col("p_name").alias("name")).distinct(), short, "name", "b")


@query("family_representative", """WITH s AS (SELECT s_suppkey AS doc, s_nationkey AS family, s_acctbal > 5000 AS has, s_acctbal < 0 AS blank FROM supplier)
SELECT family, bool_or(has) AS any_cost, bool_and(blank) AS all_blank, count(*)::BIGINT AS members, first(doc ORDER BY NOT has, blank, doc) AS representative FROM s GROUP BY 1""")  # fmt: skip
def family_representative(t: Tables) -> DataFrame:
    docs = t.supplier.select(F.col("s_suppkey").alias("doc"), F.col("s_nationkey").alias("family"), (F.col("s_acctbal") > 5000).alias("has"), (F.col("s_acctbal") < 0).alias("blank"))
    return an.family_representative(docs, "family", "has", "blank", "doc", "doc")


@query("interval_containment_anti", """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber AS s, l_linenumber + (l_quantity::INTEGER % 4) AS e, l_returnflag = 'N' AS adaptive FROM lineitem)
SELECT k, n, s, e FROM i a WHERE adaptive AND NOT EXISTS (SELECT 1 FROM i b WHERE NOT b.adaptive AND b.k = a.k AND b.s <= a.s AND b.e >= a.e)""")  # fmt: skip
def interval_containment_anti(t: Tables) -> DataFrame:
    spans = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4).alias("e"), (F.col("l_returnflag") == "N").alias("adaptive"))
    return an.not_contained(spans.where("adaptive").drop("adaptive"), spans.where("not adaptive"), "k")


@query("snapshot_sha1", """SELECT l_orderkey AS report, l_returnflag AS tbl, count(*)::BIGINT AS row_count, sha1(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) AS name_hash,
  sha1(string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) AS total_hash,
  sha1(sha1(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) || '|' || sha1(string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)))) AS hash FROM lineitem GROUP BY 1, 2""")  # fmt: skip
def snapshot_sha1(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("report"), F.col("l_returnflag").alias("tbl"), "l_linenumber", "l_partkey", "l_quantity")
    return an.snapshot(rows, "report", "tbl", ["l_linenumber"], F.col("l_partkey"), F.col("l_quantity").cast("long"))


@query("snapshot_combined", """WITH h AS (SELECT l_orderkey AS report, l_returnflag, sha1(sha1(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR))) || '|' || sha1(string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)))) AS hash
  FROM lineitem GROUP BY 1, 2) SELECT report, sha1(string_agg(hash, '|' ORDER BY hash)) AS combined_hash FROM h GROUP BY 1""")  # fmt: skip
def snapshot_combined(t: Tables) -> DataFrame:
    return an.combined_hash(snapshot_sha1(t), "report")


@query("snapshot_diff", """WITH s AS (SELECT l_orderkey AS k, sha1(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))) AS h FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
n AS (SELECT l_orderkey AS k, sha1(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR))) AS h FROM lineitem WHERE l_orderkey % 7 <> 0 AND l_linenumber < 6 GROUP BY 1)
SELECT k, CASE WHEN s.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM s FULL JOIN n USING (k) WHERE s.h IS DISTINCT FROM n.h""")  # fmt: skip
def snapshot_diff(t: Tables) -> DataFrame:
    """Two snapshots of one table set: one misses every fifth report, the other every seventh and late rows."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit(0).alias("tbl"), "l_linenumber", "l_partkey", "l_quantity")
    take = lambda d: an.snapshot(d, "k", "tbl", ["l_linenumber"], F.col("l_partkey"), F.lit("")).select("k", F.col("name_hash").alias("hash"))
    return an.snapshot_diff(take(rows.where("k % 5 <> 0")), take(rows.where("k % 7 <> 0 and l_linenumber < 6")), "k")


@query("status_counts", """SELECT o_custkey AS report, count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS completed, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS in_progress, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS planned,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS completion_rate, round(avg(CAST(o_orderkey % 10 AS DOUBLE) / 10), 6) AS avg_confidence, count(*) FILTER (CAST(o_orderkey % 10 AS DOUBLE) / 10 >= 0.7)::BIGINT AS strong FROM orders GROUP BY 1""")  # fmt: skip
def status_counts(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("planned")
    return an.report_summary(t.orders.select(F.col("o_custkey").alias("report"), status.alias("status"), ((F.col("o_orderkey") % 10).cast("double") / 10).alias("confidence")), "report")


@query("goals_filter_sort", """SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS target FROM orders WHERE o_orderpriority LIKE '%HIGH%' AND o_orderstatus IN ('O', 'P')
ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100""")  # fmt: skip
def goals_filter_sort(t: Tables) -> DataFrame:
    kept = t.orders.where(F.col("o_orderpriority").contains("HIGH") & F.col("o_orderstatus").isin("O", "P"))
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return an.top_k(kept, [rank, F.col("o_totalprice").desc(), F.col("o_orderkey")], 100).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("target"))


@query("latest_non_error", """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error'), ts DESC, event_id) AS n FROM events) WHERE n = 1""")
def latest_non_error(t: Tables) -> DataFrame:
    return an.latest(t.events, "user_id", "ts", F.col("event_type") == "error", "event_id").select("user_id", "event_id", "event_type")


@query("reason_map_merge", """SELECT event_type AS reason, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def reason_map_merge(t: Tables) -> DataFrame:
    counted = F.create_map(F.col("event_type"), F.from_json("props", "k bigint")["k"])
    return an.merged_reasons(t.events, counted, 5)


@query("index_percentiles", """WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1)
SELECT event_type, v[1] AS least, v[(n // 2) + 1] AS median, v[(90 * (n - 1) // 100) + 1] AS p90, v[(95 * (n - 1) // 100) + 1] AS p95, v[(99 * (n - 1) // 100) + 1] AS p99, v[n] AS most, mean FROM v""")  # fmt: skip
def index_percentiles(t: Tables) -> DataFrame:
    return an.index_percentiles(t.events, "event_type", "value")


@query("dollar_density", """SELECT event_id, (sum((event_type = 'purchase')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))::BIGINT AS density FROM events""")
def dollar_density(t: Tables) -> DataFrame:
    return ln.density(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 14).select("event_id", "density")


def _islands_sql(gap: int, least: int) -> str:
    return f"""WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
h AS (SELECT user_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY user_id ORDER BY p) <= {gap} THEN 0 ELSE 1 END AS fresh FROM p WHERE event_type IN ('click', 'view')),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT user_id, min(p)::BIGINT AS "start", max(p)::BIGINT AS "end", count(*)::BIGINT AS n FROM g GROUP BY user_id, g HAVING count(*) >= {least}"""


@query("dollar_islands", _islands_sql(1, 3))
def dollar_islands(t: Tables) -> DataFrame:
    return ln.islands(t.events, "user_id", ["ts", "event_id"], F.col("event_type").isin("click", "view"), least=3)


@query("gap_tolerant_clusters", _islands_sql(4, 4))
def gap_tolerant_clusters(t: Tables) -> DataFrame:
    return ln.islands(t.events, "user_id", ["ts", "event_id"], F.col("event_type").isin("click", "view"), least=4, largest_gap=4)


@query("lookahead_text", """SELECT event_id, string_agg(event_type, ' ') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS ahead FROM events""")
def lookahead_text(t: Tables) -> DataFrame:
    return ln.lookahead_text(t.events, "user_id", ["ts", "event_id"], "event_type", 6).select("event_id", "ahead")


@query("next_amount", """SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS amount FROM events""")
def next_amount(t: Tables) -> DataFrame:
    return ln.next_value(t.events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "amount").select("event_id", "amount")


@query("context_snippets", """SELECT event_id, snippet FROM (SELECT event_id, event_type, string_agg(event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS snippet FROM events) WHERE event_type = 'error'""")
def context_snippets(t: Tables) -> DataFrame:
    return ln.context(t.events, "user_id", ["ts", "event_id"], "event_type", F.col("event_type") == "error").select("event_id", "snippet")


@query("top_share", """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
WHERE r <= least(3, greatest(1, ceil(n * 0.3)))""")  # fmt: skip
def top_share(t: Tables) -> DataFrame:
    return an.top_share(t.lineitem, "l_orderkey", [F.col("l_extendedprice").desc(), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("longest_goal", """SELECT conv_id, first(turn ORDER BY len(string_split(text, ' ')) DESC, turn) AS turn FROM conversations GROUP BY 1""")
def longest_goal(t: Tables) -> DataFrame:
    words = F.size(F.split("text", " "))
    return t.conversations.groupBy("conv_id").agg(F.max_by("turn", F.struct(words, -F.col("turn"))).alias("turn"))


@query("canonical_dedupe", r"""WITH c AS (SELECT p_brand, p_partkey, p_retailprice, lower(split_part(p_name, ' ', 2)) AS noun FROM part),
d AS (SELECT *, CASE WHEN length(noun) + (p_partkey % 3 = 0)::INT > 3 THEN regexp_replace(noun || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END, '([^s])s$', '\1') ELSE noun || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END END AS canon FROM c),
r AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, canon) AS place, row_number() OVER (PARTITION BY p_brand, canon ORDER BY p_retailprice DESC, p_partkey) AS n FROM d)
SELECT p_brand, p_partkey, place FROM r WHERE n = 1""")  # fmt: skip
def canonical_dedupe(t: Tables) -> DataFrame:
    """Names that differ by case, a plural s or an end mark are one."""
    noun = F.get(F.split("p_name", " "), F.lit(1))
    written = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper(noun)).otherwise(noun), F.when(F.col("p_partkey") % 3 == 0, F.lit("s")).when(F.col("p_partkey") % 3 == 1, F.lit(",")).otherwise(F.lit("")))
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice", written.alias("noun"))
    return an.canonical_dedupe(rows, "p_brand", canonical_name(F.col("noun")), "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "place")


@query("prf1", """WITH g AS (SELECT DISTINCT doc_id % 10 AS k, doc_id FROM labels WHERE quality = 0), f AS (SELECT DISTINCT doc_id % 10 AS k, doc_id FROM labels WHERE toxic = 1),
c AS (SELECT coalesce(g.k, f.k) AS k, count(*) FILTER (g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (f.doc_id IS NULL) AS fn FROM g FULL JOIN f ON g.k = f.k AND g.doc_id = f.doc_id GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn > 0 THEN 0 ELSE 1 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM c)
SELECT k, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM m""")  # fmt: skip
def prf1(t: Tables) -> DataFrame:
    side = lambda test: t.labels.where(test).select((F.col("doc_id") % 10).alias("k"), F.col("doc_id").cast("string").alias("text"))
    return an.precision_recall(side("quality = 0"), side("toxic = 1"), ["k"])


@query("metric_value_accuracy", """WITH f AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS v FROM lineitem GROUP BY 1)
SELECT o_custkey AS report, count(*)::BIGINT AS metrics, count(*) FILTER (abs(v - o_totalprice) <= 0.2::DOUBLE * abs(o_totalprice))::BIGINT AS "right", round(count(*) FILTER (abs(v - o_totalprice) <= 0.2::DOUBLE * abs(o_totalprice)) / count(*), 6) AS accuracy
FROM orders LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY 1""")  # fmt: skip
def metric_value_accuracy(t: Tables) -> DataFrame:
    gold = t.orders.select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("label"), F.col("o_totalprice").alias("value"), F.lit("usd").alias("unit"))
    price = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2)
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("label")).agg(price.alias("value")).join(t.orders.select(F.col("o_orderkey").alias("label"), F.col("o_custkey").alias("report")), "label")
    return an.metric_accuracy(gold, found.withColumn("unit", F.lit("usd")).withColumn("pos", F.lit(0)), "report", 0.2)


@query("list_accuracy", """WITH g AS (SELECT s_nationkey AS k, floor(s_acctbal / 1000) AS x, row_number() OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) AS n FROM supplier),
f AS (SELECT c_nationkey AS k, floor(c_acctbal / 1000) AS x, row_number() OVER (PARTITION BY c_nationkey, floor(c_acctbal / 1000)) AS n FROM customer),
j AS (SELECT coalesce(g.k, f.k) AS k, count(g.n) AS gold, count(f.n) AS found, count(*) FILTER (g.n IS NOT NULL AND f.n IS NOT NULL) AS matched FROM g FULL JOIN f ON g.k = f.k AND g.x = f.x AND g.n = f.n GROUP BY 1)
SELECT k, gold::BIGINT AS gold, found::BIGINT AS found, matched::BIGINT AS matched, round(CASE WHEN gold > 0 THEN matched / gold ELSE 1 END, 6)::DOUBLE AS accuracy, round(CASE WHEN found > 0 THEN (found - matched) / found ELSE 0 END, 6)::DOUBLE AS false_positive_rate,
  CASE WHEN gold > 0 THEN matched / gold ELSE 1 END >= 0.9 AND found = matched AS passed FROM j""")  # fmt: skip
def list_accuracy(t: Tables) -> DataFrame:
    bin_of = lambda c: F.floor(F.col(c) / 1000)
    gold = t.supplier.select(F.col("s_nationkey").alias("k"), bin_of("s_acctbal").alias("x"))
    found = t.customer.select(F.col("c_nationkey").alias("k"), bin_of("c_acctbal").alias("x"))
    return an.list_accuracy(gold, found, "k", "x")


@query("filter_impact_diff", """WITH b AS (SELECT source AS f, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT source AS f, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT count(*)::BIGINT AS files, sum(b.n)::BIGINT AS baseline, sum(c.n)::BIGINT AS filtered, sum(c.n - b.n)::BIGINT AS delta, round(100.0::DOUBLE * sum(c.n - b.n) / sum(b.n), 2) AS delta_pct FROM b JOIN c USING (f)""")  # fmt: skip
def filter_impact_diff(t: Tables) -> DataFrame:
    base = t.documents.groupBy(F.col("source").alias("f")).agg(F.count("*").alias("n"))
    kept = t.documents.join(t.labels.where("quality = 1"), "doc_id").groupBy(F.col("source").alias("f")).agg(F.count("*").alias("n"))
    return an.impact(base, kept, "f")


@query("csv_export", """SELECT 'Goals' AS "Section", 'G' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS "ID", replace(s_name, ',', ' ') AS "Field1", CAST(s_nationkey AS VARCHAR) AS "Field2", '' AS "Field3" FROM supplier
UNION ALL SELECT 'BMPs', 'B' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), replace(n_name, ',', ' '), CAST(n_regionkey AS VARCHAR), '' FROM nation""")  # fmt: skip
def csv_export(t: Tables) -> DataFrame:
    from siltstone.sources.sinks import csv_rows

    goals = t.supplier.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("text"), F.col("s_nationkey").cast("string").alias("more"), F.col("s_nationkey").alias("doc_id"))
    bmps = t.nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("text"), F.col("n_regionkey").cast("string").alias("more"), F.col("n_regionkey").alias("doc_id"))
    return csv_rows(goals, bmps).select("Section", "ID", "Field1", "Field2", "Field3")


@query("wide_summary_kv", """WITH s AS (SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, max(p_size) AS largest FROM part) SELECT 'n' AS key, CAST(n AS VARCHAR) AS value FROM s UNION ALL SELECT 'brands', CAST(brands AS VARCHAR) FROM s UNION ALL SELECT 'largest', CAST(largest AS VARCHAR) FROM s""")
def wide_summary_kv(t: Tables) -> DataFrame:
    row = t.part.agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), F.max("p_size").alias("largest"))
    return an.key_values(row, ["n", "brands", "largest"])


@query("summary_tab_stats", """SELECT o_custkey AS report, round(avg(CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 50)::DOUBLE END), 6) AS avg_reduction, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01')::BIGINT AS with_deadline, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS with_responsible FROM orders GROUP BY 1""")
def summary_tab_stats(t: Tables) -> DataFrame:
    reduction = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 50).cast("double"))
    return t.orders.groupBy(F.col("o_custkey").alias("report")).agg(F.round(F.avg(reduction), 6).alias("avg_reduction"), an.count_if(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).alias("with_deadline"), an.count_if(F.col("o_orderpriority") == "1-URGENT").alias("with_responsible"))


@query("project_totals", """SELECT l_orderkey AS report, round(sum(l_extendedprice), 2) AS total, round(sum(l_tax), 4) AS landowner_match, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1""")
def project_totals(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("report")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.sum("l_tax"), 4).alias("landowner_match"), F.count("*").alias("rows"))


@query("top_pollutants", """SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 4""")
def top_pollutants(t: Tables) -> DataFrame:
    return an.top_k(t.part.groupBy("p_type").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("p_type")], 4)


@query("parameter_options", """SELECT p_brand, list_sort(list(DISTINCT p_type)) AS options FROM part GROUP BY 1""")
def parameter_options(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("options"))


@query("extraction_run_summary", """SELECT count(*)::BIGINT AS docs, count(*) FILTER (event_type <> 'error')::BIGINT AS ok, count(*) FILTER (event_type = 'error')::BIGINT AS errors, round(avg(CASE WHEN event_type <> 'error' THEN value END), 1) AS avg_value, count(*) FILTER (value = 0)::BIGINT AS zero FROM events""")
def extraction_run_summary(t: Tables) -> DataFrame:
    bad = F.col("event_type") == "error"
    return t.events.agg(F.count("*").alias("docs"), an.count_if(~bad).alias("ok"), an.count_if(bad).alias("errors"), F.round(F.avg(F.when(~bad, F.col("value"))), 1).alias("avg_value"), an.count_if(F.col("value") == 0).alias("zero"))


@query("chart_eligibility", """SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '…' ELSE p_name END AS label, p_retailprice AS value FROM part WHERE p_retailprice > 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 15""")
def chart_eligibility(t: Tables) -> DataFrame:
    label = F.when(F.length("p_name") > 12, F.concat(F.substring("p_name", 1, 9), F.lit("…"))).otherwise(F.col("p_name"))
    top = an.top_k(t.part.where("p_retailprice > 0"), [F.col("p_retailprice").desc(), F.col("p_partkey")], 15)
    return top.select("p_partkey", label.alias("label"), F.col("p_retailprice").alias("value"))


@query("missing_documents", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def missing_documents(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("expected_names", """SELECT DISTINCT p_name FROM part WHERE p_partkey % 50 = 0 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey % 50 = 1)""")
def expected_names(t: Tables) -> DataFrame:
    expected, actual = t.part.where("p_partkey % 50 = 0").select("p_name").distinct(), t.part.where("p_partkey % 50 = 1").select(F.lower("p_name").alias("n"))
    return expected.join(actual, F.lower("p_name") == F.col("n"), "left_anti")


@query("stored_or_computed_summary", """SELECT c_custkey, coalesce(stored, n, 0)::BIGINT AS goals FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS stored FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def stored_or_computed_summary(t: Tables) -> DataFrame:
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    stored = F.when(F.col("c_custkey") % 2 == 0, F.lit(7).cast("long"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(stored, "n", F.lit(0).cast("long")).alias("goals"))


@query("accuracy_panel", """SELECT count(*)::BIGINT AS lines, count(*) FILTER (l_discount = 0)::BIGINT AS excluded, round(100.0 * count(l_quantity)::DOUBLE / count(*), 1) AS numeric_pct, count(*) FILTER (l_extendedprice < 0)::BIGINT AS negative FROM lineitem""")
def accuracy_panel(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("lines"), an.count_if(F.col("l_discount") == 0).alias("excluded"), F.round(100.0 * F.count("l_quantity") / F.count("*"), 1).alias("numeric_pct"), an.count_if(F.col("l_extendedprice") < 0).alias("negative"))


@query("stream_incremental_ingest", """SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def stream_incremental_ingest(t: Tables) -> DataFrame:
    from siltstone.streaming.ingest import run_to_end

    return run_to_end(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema).groupBy("event_type").agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("total"), 2).alias("total"))
