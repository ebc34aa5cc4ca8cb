"""Readers, writers and streaming on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.sources import documents as src
from siltstone.sources import sinks
from siltstone.streaming import ingest


def test_bronze(spark, tmp_path):
    folder = tmp_path / "bronze"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"id": "a", "rawText": "whole", "metadata": {"pageCount": 3}}))
    for part, text in ((2, "two"), (10, "ten"), (1, "one")):
        (folder / f"b-{part}.json").write_text(json.dumps({"slug": "b", "part": part, "text": text}))
    (folder / "a-1.json").write_text(json.dumps({"id": "a", "part": 1, "text": "ignored"}))
    (folder / "broken.json").write_text("{")
    raw = src.read_bronze(spark, str(folder))
    assert [r["doc_id"] for r in raw.collect() if r["error"]] == ["broken"]
    whole = {r["doc_id"]: r["text"] for r in src.whole_first(raw).collect()}
    assert whole["a"] == "whole" and whole["b"] == "one\n\ntwo\n\nten"


def test_reports_logs_and_labels(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"n": 1}')
    (tmp_path / "y.json").write_text("no json")
    assert [r["doc_id"] for r in src.read_reports(spark, str(tmp_path), "n int").collect()] == ["x"]
    log = tmp_path / "log.ndjson"
    log.write_text('{"file": "a", "n": 1}\noops\n\n{"file": "b", "n": 2}\n')
    assert sorted(r["file"] for r in src.read_log(spark, str(log), "file string, n int").collect()) == ["a", "b"]
    gold = spark.createDataFrame([("r", ["g1", "g2"], None)], "report_id string, goals array<string>, bmps array<string>")
    assert {tuple(r) for r in src.gold_labels(gold).collect()} == {("r", "goals", "g1"), ("r", "goals", "g2")}
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    assert src.read_files(spark, str(tmp_path)).first()["length"] == 4


def test_slugs(spark):
    rows = spark.createDataFrame([(1, "A Plan!"), (2, "a plan"), (3, "!!!"), (4, "A-Plan")], "n int, name string")
    known = spark.createDataFrame([("document",)], "slug string")
    got = [r["slug"] for r in src.unique_slugs(rows, "name", "n", known).orderBy("n").collect()]
    assert got == ["a-plan", "a-plan-2", "document-2", "a-plan-3"]


def test_writers(spark, tmp_path):
    goals = spark.createDataFrame([("d", 0, "clean, water", None), ("d", 1, "more", "x")], "doc_id string, pos int, text string, more string")
    rows = sinks.csv_rows(goals, goals.limit(0))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    lines = next((tmp_path / "csv" / "doc_id=d").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "Section,ID,Field1,Field2,Field3" and lines[1].startswith("Goals,G1,clean  water")
    sinks.append_log(goals, str(tmp_path / "log"))
    sinks.append_log(goals, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("ts is not null").count() == 4
    current = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = sinks.upserted(current, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r["k"] for r in sinks.without(new, spark.createDataFrame([(3,), (9,)], "k int"), "k").collect()} == {1, 2}
    copies = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "k string, modificationTime int, v string")
    assert sinks.newest(copies, "k").first()["v"] == "new"


def test_stream_resumes_without_repeats(spark, tmp_path):
    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    frame = spark.range(10).select(F.col("id").alias("n"))
    frame.coalesce(1).write.parquet(str(folder / "a"))
    run = lambda: ingest.ingest(spark, str(folder / "*"), frame.schema, lambda batch, i: seen.extend(r["n"] for r in batch.collect()), state).awaitTermination()
    run()
    run()
    assert sorted(seen) == list(range(10))
    spark.range(10, 13).select(F.col("id").alias("n")).coalesce(1).write.parquet(str(folder / "b"))
    run()
    assert sorted(seen) == list(range(13))


def test_text_functions(spark):
    row = spark.createDataFrame([("x",)], "x string").select(
        tx.trimmed(F.lit("  a ﻿")).alias("trim"), tx.plain_quotes(F.lit("â€œa â€™ b’")).alias("quotes"), tx.dehyphenated(F.lit("water- shed")).alias("joined"),
        tx.money(F.lit("a 1,234.56 $7")).alias("money"), tx.money(F.lit("none")).alias("none"), tx.canonical_name(F.lit(" Sediment  Basins:")).alias("name"), tx.compact_money(F.lit(1234567.0)).alias("compact"),
        tx.cost_tail_cut(F.lit("Fencing 10,000 ft @ $2.50")).alias("cut"), tx.audience(F.lit("School visit")).alias("audience"), tx.canonical_unit(F.lit("CY.")).alias("unit"), tx.slug(F.lit("--")).alias("slug"),
    ).first()
    assert (row["trim"], row["quotes"], row["joined"], row["money"], row["none"]) == ("a", "\"a ' b'", "watershed", 1234.56, None)
    assert (row["name"], row["compact"], row["cut"], row["audience"], row["unit"], row["slug"]) == ("sediment basin", "$1.2M", "Fencing", "Education", "cu_yd", "document")
