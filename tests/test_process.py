"""The chain from goal lines to goals, the passes over practices, enrichment and the service operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.operators import entities as en
from siltstone.plans import report
from siltstone.sources import documents as src
from siltstone.sources import sinks
from siltstone.streaming import ingest as inc

WHOLE = "The ultimate goal is to bring about behavior changes and the use of \u201cbest management practices\u201d that will improve the overall quality of life in the watershed."
BROKEN = "Goals\nThe ultimate goal is to bring about behavior changes and the use of\n"
TEXTS = {
    "known": "Dry Creek Watershed Plan\n" + BROKEN + "Outreach\n\u201cbest management practices\u201d that will improve the overall quality of life in the county and beyond.\n",
    "rebuilt": "Outreach\n\u201cbest management practices\u201d that will improve the overall quality of life in the watershed.\n" + BROKEN,
    "anchored": "Monitoring\nGoal: reduce nitrogen by 20 percent in the creek and its streams\nOutreach\nour goal is to improve phosphorus in all of the lakes here",
    "semantic": "Our mission is to improve the dissolved oxygen of every stream by 2031. Other things.",
    "none": "Nothing to see here.\nBMPs\nRain garden",
    "small": "BMPs\nCover crop planting\nMonitoring\nCover crop planting $12,000\nFisheries Management $185,148\nTotal $9,000",
}


@pytest.fixture(scope="module")
def base(spark):
    return report.sectioned(spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string"))


def test_goal_chain(base):
    goals = {}
    for r in report.report_goals(base).collect():
        goals.setdefault(r["doc_id"], []).append(r)
    assert [(r["confidence"], r["primary_reason"]) for r in goals["known"]] == [(0.80, "simple_stream_capture")]
    assert [(r["title"], r["primary_reason"]) for r in goals["rebuilt"]] == [(WHOLE.replace("\u201c", '"').replace("\u201d", '"'), "explicit_phrase")]
    anchored = goals["anchored"]
    assert all(r["fallback"] for r in anchored) and [r["title"] for r in anchored] == ["reduce nitrogen by 20 percent in the creek and its streams"]
    assert goals["semantic"][0]["fallback"] and goals["semantic"][0]["title"].startswith("Our mission is to improve")
    assert set(goals) == {"known", "rebuilt", "anchored", "semantic"}


def test_sole_goals(spark):
    one = lambda c, text: spark.createDataFrame([(text,)], "t string").select(c(F.col("t"))).first()[0]
    plain = WHOLE.replace("\u201c", '"').replace("\u201d", '"')
    assert one(en.canonical_goal, "x " + WHOLE.replace(" life ", "\nlife ") + " More.")[1:] == plain[1:]
    assert one(en.known_goal, "Dry Creek Watershed Plan\n" + WHOLE) == plain and one(en.known_goal, "Another Plan\n" + WHOLE) is None
    assert one(en.repaired_goal, "The overall goal is clean\nwater in the watershed. And more.") == "overall goal is clean water in the watershed."
    assert one(en.repaired_goal, "The overall goal is clean water. In the watershed.") is None
    rows = spark.createDataFrame([("a", "goal is the use of", 0.2, None, False, "x"), ("b", "goal is the use of", 0.2, None, False, "x"), ("b", "another", 0.2, None, False, "x")], "doc_id string, title string, confidence double, primary_reason string, is_primary boolean, short_title string")
    fixed = en.repair_single(rows, spark.createDataFrame([("a", "whole."), ("b", "whole.")], "doc_id string, repair string")).collect()
    assert sorted((r["doc_id"], r["title"], r["confidence"], r["primary_reason"]) for r in fixed) == [("a", "whole.", 0.85, "raw_stream_fallback"), ("b", "another", 0.2, None), ("b", "goal is the use of", 0.2, None)]


def test_practice_steps(base):
    kept, _ = report.report_practices(base, None)
    small = {r["name"]: r for r in kept.where("doc_id = 'small'").collect()}
    assert set(small) == {"Cover crop planting", "Fisheries Management"}
    known = small["Cover crop planting"]
    assert known["confidence"] == 0.55 and known["source"].endswith("summary_line:Cover crop planting $12,000")
    new = small["Fisheries Management"]
    assert (new["confidence"], new["category"], new["id"]) == (0.25, "Aquatic", "B2")


def test_both_sources_and_trims(spark):
    rows = [("d", 0, "Fence 100 ft @ $2.00", 0.3, "a|cost_table_row:x:y|summary_line:z"), ("d", 1, "fence", 0.9, "b"), ("e", 0, "Pond", 0.2, "c"), ("e", 1, "pond", 0.3, "c")]
    found = en.trimmed_names(en.both_sources(spark.createDataFrame(rows, "doc_id string, pos int, name string, confidence double, source string"))).orderBy("doc_id", "pos").collect()
    # a cut name makes a document's repeated names one; a document without cuts keeps them
    assert [(r["doc_id"], r["name"], r["confidence"], r["original_name"]) for r in found] == [("d", "Fence", 0.6, "Fence 100 ft @ $2.00"), ("e", "Pond", 0.2, None), ("e", "pond", 0.3, None)]
    assert found[0]["source"].endswith("|name_cost_tail_trim")


def test_classifier_moves_lines(spark):
    docs = spark.createDataFrame([("d", "Plant trees\nBMPs\nRain garden"), ("n", None)], "doc_id string, text string")
    moved = report.sectioned(docs, lambda rows: rows.withColumn("section", F.when(F.col("line").contains("trees"), "BMPs").otherwise(F.col("section"))))
    assert {r["doc_id"]: [s["section"] for s in r["sections"]] for r in moved.collect()} == {"d": ["BMPs", "BMPs"], "n": []}


def test_enriched(spark):
    loose = "Intro.\n" + "\n".join(f"Item {i}\t10 ft\t${i}2,000.00" for i in range(1, 5)) + "\nThe end."
    corpus = report.process(spark.createDataFrame([("loose", loose), ("plain", "Nothing.")], "doc_id string, text string"))
    before = {r["pattern_id"] for r in corpus.cost_tables.where("doc_id = 'loose'").collect()}
    after = report.enriched(corpus)
    names = {r["name"] for r in after.practices.where("doc_id = 'loose'").collect()}
    assert after.cost_tables.where("doc_id = 'loose'").count() >= max(1, len(before)) and after.cost_tables.where("doc_id = 'plain'").count() == 0
    assert names and after.practices.where("doc_id = 'loose' AND source = 'cost_table_row'").count() == len(names)


def test_non_overlapping_and_covered(spark):
    kind = "doc_id string, pattern_id string, pattern_confidence double, span_start int, span_end int, dollar_lines array<int>, rows array<int>"
    rows = [("d", "a", 0.8, 0, 5, [1, 2], [1]), ("d", "b", 0.6, 4, 9, [4], [2]), ("d", "adaptive_generic_costs", 0.5, 1, 4, [1, 2], [3]), ("d", "adaptive_generic_costs", 0.5, 20, 24, [21], [4]), ("e", "adaptive_generic_costs", 0.5, 1, 4, [1], [5])]
    tables = spark.createDataFrame(rows, kind)
    assert sorted(r["rows"][0] for r in ce.drop_covered(tables).collect()) == [1, 2, 4, 5]
    assert sorted(r["rows"][0] for r in ce.non_overlapping(tables).collect()) == [1, 4, 5]
    assert ce.drop_covered(tables).columns == tables.columns == ce.non_overlapping(tables).columns


def test_percentiles_of_skewed_values(spark):
    values = [5.0] * 700 + [float(i) for i in range(300)] + [1e9]
    frame = spark.createDataFrame([("k", v) for v in values] + [("one", 3.0), ("none", None)], "k string, v double")
    got = {r["k"]: r for r in an.index_percentiles(frame, "k", "v", (50, 90, 99)).collect()}
    ordered, n = sorted(values), len(values)
    assert (got["k"]["median"], got["k"]["p50"], got["k"]["p90"], got["k"]["p99"], got["k"]["most"]) == (ordered[n // 2], ordered[50 * (n - 1) // 100], ordered[90 * (n - 1) // 100], ordered[99 * (n - 1) // 100], 1e9)
    assert got["one"]["median"] == got["one"]["p99"] == 3.0 and "none" not in got


def test_slugs_beyond_fifty(spark):
    rows = spark.createDataFrame([(i, "A plan") for i in range(60)], "n int, name string")
    slugs = [r["slug"] for r in src.unique_slugs(rows, "name", "n").orderBy("n").collect()]
    assert slugs[:3] == ["a-plan", "a-plan-2", "a-plan-3"] and slugs[49] == "a-plan-50" and len(set(slugs)) == 60
    assert all(len(s) == len("a-plan-") + 8 for s in slugs[50:])


def test_versioned_upserts(spark, tmp_path):
    path = str(tmp_path / "silver")
    assert sinks.versions(spark, path) == [] and sinks.read_current(spark, path) is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.upsert(rows, path, "k")
    now = sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, now.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.read_current(spark, path, 0).collect())) == [(1, "a"), (2, "b")]
    assert src.stored_metric(spark, path + "/none", "k int") is None
    sinks.write_json(rows, str(tmp_path / "metric"))
    assert src.stored_metric(spark, str(tmp_path / "metric"), "k int, v string").count() == 2


def test_uploads_and_streams(spark, tmp_path):
    files = spark.createDataFrame([("/x/A.PDF", b"1"), ("/x/b.txt", b"2")], "path string, content binary")
    assert [r["name"] for r in src.uploads(files).collect()] == ["A.PDF"]
    assert [(r["text"], r["pages"]) for r in src.uploads(files, skip_parse=True).collect()] == [(src.SKIPPED_TEXT, 0)]
    spark.sql("SELECT 'e1' AS event_id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'e1', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 'e2', timestamp'2024-01-01 00:02:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = inc.deduplicated(spark.readStream.schema("event_id string, ts timestamp").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("dedup").collect()) == ["e1", "e2"]
    usage = inc.running_pattern_usage(spark.readStream.schema("event_id string, ts timestamp").parquet(str(tmp_path / "in")).selectExpr("event_id AS pattern_id", "2.0D AS total_computed"))
    usage.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["pattern_id"], r["tables"], r["total"]) for r in spark.table("usage").collect()) == [("e1", 2, 4.0), ("e2", 1, 2.0)]
