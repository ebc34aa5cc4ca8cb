"""Corpus analytics: aggregations, joins, rankings and audits over reports.

Functions take DataFrames with the columns they name and return DataFrames, so
Catalyst sees one plan.  Money is rounded to cents after summing; ratios guard
against zero; every ranking ends in a tie-breaker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(c: Column) -> Column:
    return F.round(c, 2)


def non_zero(c: Column) -> Column:
    """Null for zero: a total of nothing is no total."""
    return F.when(c != 0, c)


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.when(whole != 0, part / whole), digits)


def count_if(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0)).cast("long")


def positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(0.0)


# --- cost analytics over tables (report_id, pattern_id, confidence, reported, computed) ---


def report_list(tables: DataFrame) -> DataFrame:
    """Per report: totals of its tables, the difference where both are there, tables and patterns."""
    agg = tables.groupBy("report_id").agg(
        cents(F.sum(positive("reported"))).alias("r"), cents(F.sum(positive("computed"))).alias("c"),
        count_if((F.coalesce("reported", F.lit(0.0)) > 0) | (F.coalesce("computed", F.lit(0.0)) > 0)).alias("table_count"), F.count_distinct("pattern_id").alias("pattern_count"),
    )
    return agg.select("report_id", non_zero(F.col("r")).alias("total_reported"), non_zero(F.col("c")).alias("total_computed"), cents(F.when((F.col("r") != 0) & (F.col("c") != 0), F.col("r") - F.col("c"))).alias("discrepancy"), "table_count", "pattern_count")


def cost_summary(tables: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: reports, those with costs, totals, confidence-weighted total and reports off by more than the tolerance."""
    doc = tables.groupBy("report_id").agg(F.sum(positive("reported")).alias("r"), F.sum(positive("computed")).alias("c"), F.sum(positive("computed") * F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(1.0))).alias("w"))
    off = (F.col("r") > 0) & (F.col("c") > 0) & (F.abs(F.col("r") - F.col("c")) / F.col("c") > tolerance)
    return doc.agg(
        F.count("*").alias("report_count"), count_if((F.col("r") > 0) | (F.col("c") > 0)).alias("reports_with_costs"), cents(F.sum("r")).alias("total_reported"), cents(F.sum("c")).alias("total_computed"),
        cents(F.sum("r") - F.sum("c")).alias("discrepancy"), cents(F.sum("w")).alias("weighted_total"), count_if(off).alias("discrepancy_flags"),
    )


def pattern_usage(tables: DataFrame) -> DataFrame:
    """Per pattern: tables, totals, how many report a total, and how many are within 1 and 5 percent of the computed one."""
    both = (F.col("reported") > 0) & (F.col("computed") > 0)
    rel = F.abs(F.col("reported") - F.col("computed")) / F.col("computed")
    n = count_if(both)
    return tables.groupBy("pattern_id").agg(
        F.count("*").alias("table_count"), cents(F.sum(positive("reported"))).alias("total_reported"), cents(F.sum(positive("computed"))).alias("total_computed"),
        cents(F.sum(positive("computed") * F.least("confidence", F.lit(1.0)))).alias("weighted_total"), count_if(F.col("reported") > 0).alias("with_reported"), n.alias("total_with_both"),
        share(count_if(both & (rel <= 0.01)), n).alias("within_1"), share(count_if(both & (rel <= 0.05)), n).alias("within_5"),
        cents(F.avg(F.when(both, F.col("reported") - F.col("computed")))).alias("avg_discrepancy"),
    )


def pattern_totals(tables: DataFrame) -> DataFrame:
    """Per pattern and over all (pattern ``*``): tables and totals, in one rollup."""
    agg = tables.rollup("pattern_id").agg(F.grouping("pattern_id").alias("_g"), F.count("*").alias("table_count"), cents(F.sum("reported")).alias("total_reported"), cents(F.sum("computed")).alias("total_computed"))
    return agg.select(F.when(F.col("_g") == 1, F.lit("*")).otherwise(F.coalesce("pattern_id", F.lit("unknown"))).alias("pattern_id"), "table_count", "total_reported", "total_computed")


def verify_totals(tables: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per table: the ratio of reported to computed total and whether it is within the tolerance."""
    verdict = F.when(F.col("reported").isNull(), "skipped").when(F.coalesce("computed", F.lit(0.0)) == 0, "failed")
    ratio = F.col("reported") / F.nullif(F.col("computed"), F.lit(0.0))
    return tables.select("report_id", "pattern_id", F.round(ratio, 6).alias("ratio"), verdict.when((ratio >= 1 / (1 + tolerance)) & (ratio <= 1 + tolerance), "ok").otherwise("failed").alias("verdict"))


def discrepancy_buckets(tables: DataFrame) -> DataFrame:
    """Per pattern: cumulative shares of tables within 1 and 5 percent and beyond 20 percent of the *reported* total."""
    rel = F.abs(F.col("reported") - F.col("computed")) / F.nullif(F.col("reported"), F.lit(0.0))
    return tables.groupBy("pattern_id").agg(F.count("*").alias("tables"), F.count_distinct("report_id").alias("reports"), count_if(rel <= 0.01).alias("within_1"), count_if(rel <= 0.05).alias("within_5"), count_if(rel > 0.20).alias("over_20"))


def funding_allocation(rows: DataFrame, key: str) -> DataFrame:
    """Per key: contributions, the total (their sum where none is given) and shares."""
    agg = rows.groupBy(key).agg(*[cents(F.sum(F.coalesce(c, F.lit(0.0)))).alias(c) for c in ("producer", "nrcs", "other", "total")])
    parts = F.col("producer") + F.col("nrcs") + F.col("other")
    agg = agg.withColumn("total", cents(F.coalesce(non_zero(F.col("total")), parts)))
    return agg.select(key, "producer", "nrcs", "other", "total", *[share(F.col(c), F.col("total"), 4).alias(f"share_{c}") for c in ("producer", "nrcs", "other")])


# --- joins ---


def not_contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Intervals (key, s, e) that no interval of the other side with the same key covers."""
    o = outer.select(F.col(key).alias("_k"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    return inner.join(o, (inner[key] == o["_k"]) & (o["_s"] <= inner["s"]) & (o["_e"] >= inner["e"]), "left_anti")


def contained_in(entities: DataFrame, texts: DataFrame, key: str, entity: str, text: str) -> DataFrame:
    """Entities with ``present``: whether their own document's text has them, case aside."""
    joined = entities.join(texts.select(key, F.col(text).alias("_text")), key, "left")
    return joined.withColumn("present", F.coalesce(F.contains(F.lower("_text"), F.lower(entity)), F.lit(False))).drop("_text")


def mutual_prefix(left: DataFrame, right: DataFrame, l: str, r: str, least: int = 3) -> DataFrame:
    """Rows of the left side whose text is a prefix of one on the right, or the other way round.

    One side starts with the other exactly if they agree on the shorter one's
    length.  The join is therefore an equi-join on every prefix length that
    occurs among the shorter keys, without comparing all pairs; texts shorter
    than ``least`` have no partner.
    """
    a = left.select(F.col(l).alias("_a")).distinct().where(F.length("_a") >= least)
    b = right.select(F.col(r).alias("_b")).distinct().where(F.length("_b") >= least)
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(least), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    whole_left = a.join(b.select(prefixes("_b").alias("_p")).distinct(), F.col("_a") == F.col("_p"), "left_semi")
    whole_right = a.select("_a", prefixes("_a").alias("_p")).join(b, F.col("_p") == F.col("_b"), "left_semi").select("_a")
    return left.join(whole_left.unionAll(whole_right).distinct(), left[l] == F.col("_a"), "left_semi")


def snapshot(rows: DataFrame, report: str, table: str, order: Sequence[str], name: Column, total: Column) -> DataFrame:
    """Per table: sha1 of its names, of its totals and of both; the same over the report's tables."""
    listed = F.array_sort(F.collect_list(F.struct(*order, name.cast("string").alias("_n"), total.cast("string").alias("_t"))))
    agg = rows.groupBy(report, table).agg(F.count("*").alias("row_count"), listed.alias("_l"))
    joined = lambda f: F.sha1(F.array_join(F.transform("_l", lambda x: x[f]), "|").cast("binary"))
    agg = agg.select(report, table, "row_count", joined("_n").alias("name_hash"), joined("_t").alias("total_hash"))
    return agg.withColumn("hash", F.sha1(F.concat_ws("|", "name_hash", "total_hash").cast("binary")))


def combined_hash(tables: DataFrame, report: str) -> DataFrame:
    return tables.groupBy(report).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("hash")), "|").cast("binary")).alias("combined_hash"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """ADDED, REMOVED and CHANGED tables between two snapshots."""
    o, n = old.select(F.col(key), F.col("hash").alias("_o")), new.select(F.col(key), F.col("hash").alias("_n"))
    state = F.when(F.col("_o").isNull(), "ADDED").when(F.col("_n").isNull(), "REMOVED").when(F.col("_o") != F.col("_n"), "CHANGED")
    return o.join(n, key, "full").select(key, state.alias("change")).where("change is not null")


# --- rankings and windows ---


def latest(rows: DataFrame, key: str, time: str, bad: Column, tie: str) -> DataFrame:
    """Per key the latest row that is not bad, or the latest bad one if all are."""
    w = Window.partitionBy(key).orderBy((~bad).desc(), F.col(time).desc(), F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_best(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def canonical_dedupe(rows: DataFrame, group: str, canon: Column, confidence: str, pos: str) -> DataFrame:
    """Per group and canonical name the most confident row, at the place of the first: one aggregation, combined before the shuffle."""
    rest = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.withColumn("_c", canon).groupBy(group, "_c").agg(F.min_by(rest, F.struct(-F.col(confidence), F.col(pos))).alias("_r"), F.min(pos).alias("place"))
    return best.select("_r.*", "place")


def index_percentiles(rows: DataFrame, key: str, value: str, percents: Sequence[int] = (90, 95, 99), buckets: int = 4096) -> DataFrame:
    """Per key: min, max, mean, the element at the middle and at each percentile's index of the sorted values; null values are left out.

    Values are counted by bucket between the key's least and greatest; running
    sums tell the bucket that has each index, and only those buckets' values, as
    counts of distinct ones, are put in order.  No task holds a key's values.
    """
    rows = rows.select(key, F.col(value).cast("double").alias("_v"), F.col(value).alias("_x")).where("_v IS NOT NULL")
    whole = rows.groupBy(key).agg(F.count("*").alias("_n"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.round(F.avg("_x"), 6).alias("mean"))
    reach = F.col("most").cast("double") - F.col("least").cast("double")
    bucket = F.when(reach > 0, F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("least")) / reach * buckets))).otherwise(0).cast("int")
    counted = rows.join(whole.select(key, "least", "most"), key).groupBy(key, bucket.alias("_b"), "_x").agg(F.count("*").alias("_c"))
    names = ["median", *[f"p{p}" for p in percents]]
    places = [F.floor(F.col("_n") / 2), *[F.floor(F.lit(p) * (F.col("_n") - 1) / 100) for p in percents]]
    wanted = whole.select(key, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in zip(names, places, strict=True)])).alias("w")).select(key, "w.*")
    order = Window.partitionBy(key).orderBy("_b")
    sums = counted.groupBy(key, "_b").agg(F.sum("_c").alias("_s")).withColumn("_to", F.sum("_s").over(order)).withColumn("_from", F.col("_to") - F.col("_s"))
    hit = sums.join(wanted, key).where("at >= _from AND at < _to").select(key, "_b", "_from", "name", "at")
    inside = counted.join(hit.select(key, "_b", "_from").distinct(), [key, "_b"])
    inside = inside.withColumn("_end", F.col("_from") + F.sum("_c").over(Window.partitionBy(key, "_b").orderBy("_x"))).withColumn("_begin", F.col("_end") - F.col("_c"))
    found = inside.drop("_from").join(hit.select(key, "_b", "name", "at"), [key, "_b"]).where("at >= _begin AND at < _end")
    picked = found.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("_x"))).alias(n) for n in names])
    return whole.join(picked, key).select(key, "least", *names, "most", "mean")


def top_share(rows: DataFrame, key: str, order: Sequence[Column], part: float = 0.3, least: int = 1, most: int = 3) -> DataFrame:
    """Per key the first rows by order: a share of them, within bounds."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w)
    keep = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n * part)))
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("_k", keep).where("_r <= _k").drop("_r", "_k")


def top_k(rows: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return rows.orderBy(*by).limit(k)


def key_values(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as (key, value) text rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return row.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


# --- evaluation ---


def precision_recall(gold: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys: precision, recall and F1 of distinct texts; an empty pair counts as perfect."""
    g, f = gold.select(*keys, "text").distinct().withColumn("_g", F.lit(1)), found.select(*keys, "text").distinct().withColumn("_f", F.lit(1))
    both = g.join(f, [*keys, "text"], "full")
    agg = both.groupBy(*keys).agg(count_if(F.col("_g").isNotNull() & F.col("_f").isNotNull()).alias("tp"), count_if(F.col("_g").isNull()).alias("fp"), count_if(F.col("_f").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(fn > 0, 0.0).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return agg.select(*keys, "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def metric_accuracy(gold: DataFrame, found: DataFrame, key: str, tolerance: float) -> DataFrame:
    """gold, found: (key, label, value, unit).  Share of gold metrics whose first match by label has the value and unit."""
    first = keep_best(found, [key, "label"], [F.col("pos")])
    j = gold.alias("g").join(first.alias("f"), [key, "label"], "left")
    right = (F.abs(F.col("f.value") - F.col("g.value")) <= tolerance * F.abs(F.col("g.value"))) & (F.col("f.unit") == F.col("g.unit"))
    return j.groupBy(key).agg(F.count("*").alias("metrics"), count_if(F.coalesce(right, F.lit(False))).alias("right"), share(count_if(F.coalesce(right, F.lit(False))), F.count("*")).alias("accuracy"))


def list_accuracy(gold: DataFrame, found: DataFrame, group: str, key: str) -> DataFrame:
    """Multiset matching one to one by key: matched share of gold, unmatched share of found, and the gate."""
    both = gold.select(group, key, F.lit(1).alias("_g"), F.lit(0).alias("_f")).unionByName(found.select(group, key, F.lit(0).alias("_g"), F.lit(1).alias("_f")))
    counted = both.groupBy(group, key).agg(F.sum("_g").alias("_g"), F.sum("_f").alias("_f"))
    j = counted.groupBy(group).agg(F.sum("_g").alias("gold"), F.sum("_f").alias("found"), F.sum(F.least("_g", "_f")).alias("matched"))
    accuracy = F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")).otherwise(1.0)
    false = F.when(F.col("found") > 0, (F.col("found") - F.col("matched")) / F.col("found")).otherwise(0.0)
    return j.select(group, "gold", "found", "matched", F.round(accuracy, 6).alias("accuracy"), F.round(false, 6).alias("false_positive_rate"), ((accuracy >= 0.9) & (false == 0)).alias("passed"))


def matched_reports(gold: DataFrame, silver: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, missing): gold reports with the silver ones of their id, and gold ids that have none."""
    return gold.join(silver, key), gold.join(silver.select(key), key, "left_anti").select(key)


def jaccard(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """Per group the Jaccard likeness of two item sets; two empty sets count as alike, and have no row."""
    both = left.select(group, item, F.lit(1).alias("_s")).unionByName(right.select(group, item, F.lit(2).alias("_s"))).groupBy(group, item).agg(F.bit_or("_s").alias("_s"))
    return both.groupBy(group).agg(count_if(F.col("_s") == 3).alias("common"), F.count("*").alias("every")).withColumn("jaccard", F.round(F.col("common") / F.col("every"), 6))


def normalized_of(tables: DataFrame, normalized: DataFrame, report: str, table: str) -> DataFrame:
    """Tables with the first normalized one of their id (report, table, pos, rows)."""
    rest = [c for c in normalized.columns if c not in (report, table)]
    first = normalized.groupBy(report, table).agg(F.min_by(F.struct(*rest), "pos").alias("_r"))
    return tables.join(first, [report, table], "left").select(*tables.columns, *[F.col(f"_r.{c}").alias(f"normalized_{c}") for c in rest])


# --- orders of displayed lists ---

#: Ways to order a list of reports, greatest first: each by a column of the list; any other goes by id.
REPORT_ORDERS = {"recent": "generated_at", "tables": "tables", "reported": "total_reported", "computed": "total_computed", "discrepancy": "discrepancy", "patterns": "pattern_count"}


def ordered_reports(reports: DataFrame, by: str = "id", first: int = 100) -> DataFrame:
    """The first reports in one of the ``REPORT_ORDERS``, with their place; missing values count as least, differences by size, ties go by id, case aside."""
    ties = [F.lower("id"), F.col("id")]
    if by not in REPORT_ORDERS:
        return placed(reports, ties, first)
    c = F.col(REPORT_ORDERS[by])
    c = c if by == "recent" else F.abs(F.coalesce(c, F.lit(0))) if by == "discrepancy" else F.coalesce(c, F.lit(0))
    return placed(reports, [c.desc_nulls_last(), *ties], first)


def ordered_practices(practices: DataFrame, by: str, first: int = 100) -> DataFrame:
    """The costliest practices by ``total``, ``nrcs`` or ``producer``, ties by name."""
    if by not in ("total", "nrcs", "producer"):
        raise ValueError(by)
    return placed(practices, [F.coalesce(F.col(by), F.lit(0.0)).desc(), F.lower("name"), F.col("id")], first)


def ordered_usage(usage: DataFrame, first: int = 100) -> DataFrame:
    """Patterns by number of tables, most first, ties by id."""
    return placed(usage, [F.col("tables").desc(), F.col("pattern_id")], first)


def costs_first(reports: DataFrame, first: int = 100) -> DataFrame:
    """Reports with costs before those without, each by id, case aside."""
    return placed(reports, [F.col("has_cost").desc(), F.lower("id"), F.col("id")], first)


def placed(rows: DataFrame, order: Sequence[Column], first: int) -> DataFrame:
    """The first rows by an order, numbered: a bounded top-k, so that the numbering is a small task."""
    return rows.orderBy(*order).limit(first).withColumn("place", F.row_number().over(Window.orderBy(*order)))


# --- smaller filters and audits ---

#: The rows that a phase-one table may have.
PHASE_ONE = (
    "grade stabilization structure", "heavy use area protection", "tank/trough", "cover crops", "fencing", "pond", "technical assistance", "education and outreach", "monitoring",
    "project management implementation coordination plan revision",
)


def id_contains(rows: DataFrame, id_col: str, part: str) -> DataFrame:
    return rows.where(F.lower(id_col).contains(part.lower()))


def phase_one_only(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows that a phase-one table may have: case, ``&`` and marks other than a slash aside."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), ",", " "), r"\s*&\s*", " and ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9/\s]", " "), r"\s+", " "))
    return rows.where(plain.isin(list(PHASE_ONE)))


def ocr_needed(runs: DataFrame, error: str = "error") -> DataFrame:
    """Documents whose parsing gave no text."""
    return runs.where(F.col(error).contains("empty-text"))


def reextraction_candidates(documents: DataFrame, id_col: str, text_col: str, cut: int = 18000, short: int = 600) -> DataFrame:
    """Documents cut at the chunk length, and numbered parts that are suspiciously short."""
    n = F.length(text_col)
    return documents.where((n == cut) | (F.col(id_col).cast("string").rlike(r"-\d+$") & (n > 0) & (n < short)))


def extraction_test(documents: DataFrame, practices: DataFrame, key: str, truncated: Column) -> DataFrame:
    """One row: documents, those with practices and their share, practices a document, and truncated ones."""
    per = documents.select(key, truncated.alias("_t")).join(practices.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    some = count_if(F.col("_n") > 0)
    return per.agg(F.count("*").alias("documents"), some.alias("with_practices"), F.round(100.0 * some / F.count("*"), 2).alias("pct"), F.round(F.sum(F.coalesce("_n", F.lit(0))) / F.count("*"), 2).alias("avg_practices"), count_if(F.col("_t")).alias("truncated"))


def impact(baseline: DataFrame, filtered: DataFrame, key: str) -> DataFrame:
    """Totals of both runs over the files that both have, the change and its percentage."""
    j = baseline.select(key, F.col("n").alias("_b")).join(filtered.select(key, F.col("n").alias("_f")), key)
    change = F.sum(F.col("_f") - F.col("_b"))
    return j.agg(F.count("*").alias("files"), F.sum("_b").alias("baseline"), F.sum("_f").alias("filtered"), change.alias("delta"), F.round(F.when(F.sum("_b") != 0, 100.0 * change / F.sum("_b")), 2).alias("delta_pct"))


def merged_reasons(rows: DataFrame, reasons: Column, k: int | None = None) -> DataFrame:
    """Counts of a map column added up by key, most first."""
    agg = rows.select(F.explode(reasons).alias("reason", "n")).groupBy("reason").agg(F.sum("n").cast("long").alias("n"))
    return top_k(agg, [F.col("n").desc(), F.col("reason")], k) if k else agg


def report_summary(goals: DataFrame, key: str) -> DataFrame:
    """Per report: goals by state, completion rate, average confidence and strong goals."""
    return goals.groupBy(key).agg(
        F.count("*").alias("total"), count_if(F.col("status") == "completed").alias("completed"), count_if(F.col("status") == "in_progress").alias("in_progress"), count_if(F.col("status") == "planned").alias("planned"),
        F.round(count_if(F.col("status") == "completed") / F.count("*"), 6).alias("completion_rate"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("avg_confidence"), count_if(F.col("confidence") >= 0.7).alias("strong"),
    )


def family_representative(docs: DataFrame, family: str, has: str, blank: str, pos: str, doc: str) -> DataFrame:
    """Per family: whether any member has costs, whether all are blank, and the best member."""
    best = F.min_by(doc, F.struct(~F.col(has), F.col(blank), F.col(pos)))
    return docs.groupBy(family).agg(F.bool_or(has).alias("any_cost"), F.bool_and(blank).alias("all_blank"), F.count("*").alias("members"), best.alias("representative"))


def layer_coverage(base: DataFrame, layers: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per layer: base keys that it has, percent and missing."""
    found = base.select(key).distinct()
    for name, layer in layers.items():
        found = found.join(layer.select(key).distinct().withColumn(f"_{name}", F.lit(1)), key, "left")
    n = F.count("*")
    agg = found.agg(n.alias("base"), *[F.count(f"_{name}").alias(name) for name in layers])
    return agg.select("base", F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.col(x).alias("n")) for x in layers])).alias("l")).select(
        "l.layer", "l.n", "base", F.round(100.0 * F.col("l.n") / F.col("base"), 1).alias("pct"), (F.col("base") - F.col("l.n")).alias("missing")
    )


def newest_sessions(rows: DataFrame, key: str, time: str, tie: str, most: int = 12) -> DataFrame:
    """The latest ``most`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def collapsed_rows(rows: DataFrame, keys: Sequence[str], cost: str) -> DataFrame:
    """Rows of equal keys as one, with the sum of their distinct rounded costs."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum_distinct(F.round(cost, 0)).alias("cost"))


def scan_scores(lines: DataFrame, doc: str, line: str, k: int = 25) -> DataFrame:
    """Documents by a weighted count of cost headings (5), amounts (2) and practice cues (1), highest first."""
    head, amount, cue = F.col(line).rlike(r"(?i)cost|budget"), F.col(line).rlike(r"\$[0-9]"), F.col(line).rlike(r"(?i)bmp|practice|activity")
    agg = lines.groupBy(doc).agg(count_if(head).alias("heads"), count_if(amount).alias("amounts"), count_if(cue).alias("cues"))
    return top_k(agg.withColumn("score", F.col("heads") * 5 + F.col("amounts") * 2 + F.col("cues")), [F.col("score").desc(), F.col(doc)], k)


def multipart_anomalies(parts: DataFrame, base: str, size: str, ratio: float = 25, least: int = 200) -> DataFrame:
    """Bases whose parts differ too much in size, or have one that is too small."""
    agg = parts.groupBy(base).agg(F.count("*").alias("parts"), F.min(size).alias("smallest"), F.max(size).alias("largest"))
    return agg.where((F.col("parts") > 1) & ((F.col("largest") > ratio * F.col("smallest")) | (F.col("smallest") < least)))
