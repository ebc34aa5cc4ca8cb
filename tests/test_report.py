"""From text to reports, end to end, and that processing twice gives the same."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.operators import entities as en
from siltstone.operators import lines as ln
from siltstone.operators import paragraphs
from siltstone.plans import report

PLAN = """Introduction to the plan
Goals:
The goal is to reduce sediment loads by 35 percent by 2030.
Reduce nitrogen from 40 lbs to 20 lbs; improve the dissolved oxygen of streams
BMPs
Install 5 acres of riparian buffer
Budget 2011
Fencing 10,000 ft @ $2.50
Implementation:
Monitor stream quarterly, lead: Soil District, $5,000 in 2025
Monitoring
Turbidity at the bridge
Outreach
School visits
Geography:
Dry fork
"""
COSTS = "BMPs\nCode Practice Units Cost Estimated Units Total\n314 Brush Management ac $44.70            500  $22,350.00\n340 Cover Crop ac $72.93 1,192 $86,932.56\nTotal $109,282.56"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("plan", PLAN), ("costs", COSTS), ("list", "These BMPs include the following:\n- Rain Garden\n* Filter Strip\nTotal\n"), ("ultimate", "x The ultimate goal is to bring about cleaner water in the\nwatershed. More."), ("null", None)]
    return report.process(spark.createDataFrame(rows, "doc_id string, text string"))


def test_sections(spark):
    rows = ln.section_lines(spark.createDataFrame([("a", "Intro\nGoals:\nReduce sediment by 30%.\nBMPs\nRain garden\nOther")], "doc_id string, text string"), "doc_id", "text").orderBy("pos").collect()
    assert [(r["section"], r["line"]) for r in rows] == [("uncategorized", "Intro"), ("Goals", "Reduce sediment by 30%."), ("BMPs", "Rain garden"), ("BMPs", "Other")]


def test_goals(corpus):
    goals = {r["title"]: r for r in corpus.goals.where("doc_id = 'plan'").collect()}
    first = goals["The goal is to reduce sediment loads by 35 percent by 2030."]
    assert (first["pollutant"], first["reduction_percent"], first["reduction_src"], first["deadline"], first["primary_reason"]) == ("sediment", 35, "verb_pattern", "2030-12-31", "explicit_phrase")
    assert first["confidence"] == pytest.approx(0.65)
    ultimate = corpus.goals.where("doc_id = 'ultimate'").collect()
    assert [(r["title"], r["confidence"]) for r in ultimate] == [("The ultimate goal is to bring about cleaner water in the watershed.", 0.95)]


def test_practices(corpus):
    got = {r["keyword"]: r for r in corpus.practices.where("doc_id = 'plan'").collect()}
    buffer = got["riparian buffer"]
    assert buffer["name"] == "Install" and got["Fencing"]["name"] == "Fencing"  # quantities and prices are cut off
    assert (buffer["category"], buffer["keyword"], buffer["quantity"], buffer["unit"], buffer["verb"], buffer["confidence"]) == ("Vegetative Buffer", "riparian buffer", 5, "acres", "install", 0.8)
    rejected = {r["name"]: r["reject_reasons"] for r in corpus.rejected.where("doc_id = 'plan'").collect()}
    assert rejected["Budget 2011"] == ["starts_bad_token", "cost_context"]
    assert [r["name"] for r in corpus.practices.where("doc_id = 'list'").orderBy("pos").collect()] == ["Rain Garden", "Filter Strip"]
    assert corpus.practices.where("doc_id = 'list'").first()["confidence"] == 0.22


def test_activities_and_plain_sections(corpus):
    act = corpus.activities.where("doc_id = 'plan'").first()
    assert (act["verb"], act["frequency"], act["due_year"], act["responsible"], act["cost_value"], act["confidence"]) == ("monitor", "quarterly", "2025", "Soil District", 5000, 0.9)
    assert corpus.implementation.where("doc_id = 'plan'").first()["date"] == "2025-01-01"
    assert corpus.outreach.first()["audience"] == "Education" and corpus.monitoring.first()["id"] == "M1" and corpus.geography.first()["area"] == "Dry fork"


def test_summary(corpus):
    rows = {r["doc_id"]: r for r in report.summary(corpus).collect()}
    assert set(rows) == {"plan", "costs", "list", "ultimate", "null"}
    assert rows["plan"]["activities"] == 1 and rows["null"]["total"] == 0
    assert rows["costs"]["table_count"] >= 1 and rows["costs"]["total_reported"] >= 109282.56


def test_twice_is_the_same(spark, corpus):
    again = report.process(corpus.documents.repartition(3))
    for name in ("goals", "practices", "activities"):
        a, b = (sorted(map(str, getattr(c, name).collect())) for c in (corpus, again))
        assert a == b
    kept, rejected = corpus.practices, corpus.rejected
    assert kept.join(rejected, ["doc_id", "name"], "left_semi").count() == 0


def test_joins_and_sentences(spark):
    frame = spark.createDataFrame([(["Plant trees along", "the creek.", "Our goal is", "Clean water", "for all.", "", "next"],)], "lines array<string>")
    assert frame.select(ln.join_wrapped(F.col("lines"))).first()[0] == ["Plant trees along the creek.", "Our goal is Clean water for all.", "next"]
    text = spark.createDataFrame([("One two. three four. Five in order to go! Six",)], "t string")
    assert text.select(ln.sentences(F.col("t"))).first()[0] == ["One two. three four.", "Five in order to go!", "Six"]
    assert spark.createDataFrame([("a; b;;c",)], "t string").select(ln.clauses(F.col("t"))).first()[0] == ["a", "b", "c"]


def test_paragraphs():
    lines = ["Intro.", "The overall goal is to bring back", "clean water to the creek", "for everyone.", "", "Table 1"]
    assert paragraphs.merged(lines, lines[1]) == "The overall goal is to bring back clean water to the creek for everyone."
    assert paragraphs.extended(["works for", "the town", "x"], "works for") == "works for the town"
    assert paragraphs.paragraph(lines, lines[1]) == "The overall goal is to bring back clean water to the creek for everyone."
    assert paragraphs.paragraph(lines, "Nothing like it here at all") is None


def test_primary_fallbacks(spark):
    rows = [("a", 1, i, f"goal number {i} of the plan", None, None, None, None, 0.1 * i) for i in range(1, 5)]
    goals = spark.createDataFrame(rows, "doc_id string, via int, pos int, title string, pollutant string, reduction_percent double, baseline_value double, target_value double, confidence double")
    best = en.classify_primary(goals).where("is_primary").collect()
    assert [(r["pos"], r["primary_reason"]) for r in best] == [(4, "fallback_top_confidence")]
    some = en.classify_primary(goals.withColumn("pollutant", F.lit("lead"))).where("is_primary").collect()
    assert sorted(r["pos"] for r in some) == [3, 4]
