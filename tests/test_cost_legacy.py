"""Older kinds of cost tables, loose clusters and their merge with the registry."""

from __future__ import annotations

import pytest

from siltstone.operators import cost_engine as ce
from siltstone.operators import cost_legacy as cl

FULL = "Cost Estimate: Full Project Implementation\nBMPs* Size/Amount Estimated Cost\nSediment Basin 2 each @ $6,250 $12,500\nCover Crops 800 ac @ $73 $58,400\ncover crops 800 ac @ $73 $58,400\nTotal Estimated Cost $70,900"
CLUSTER = "Estimated budget\nFencing  100 ft  $2,000\nPonds  2 ea  $3,000\nTerraces  50 ft  $4,000\n\nTotal for all items $9,000"
BOOTHS = "Code Practice Units Cost Estimated Units Total\n314 Brush Management ac $44.70            500  $22,350.00\nTotal $22,350.00"


@pytest.fixture(scope="module")
def lined(spark):
    rows = [("full", FULL), ("booths", BOOTHS), ("generic", "A cost estimate follows\nFencing 3 ea $900\nTotal Estimated Cost $900"), ("none", "no money"), ("null", None)]
    return ce.document_lines(spark.createDataFrame(rows, "doc_id string, text string")).cache()


def test_legacy(lined):
    registry = ce.cost_tables(lined)
    found = cl.legacy_tables(lined, registry)
    got = {(r["doc_id"], r["pattern_id"]): r for r in found.collect()}
    full = got["full", "full_project_estimate"]
    assert (len(full["rows"]), full["total_computed"], full["total_reported"]) == (2, 70900, 70900)
    assert [(r["quantity"], r["unit_cost"]) for r in full["rows"]] == [(2, 6250), (800, 73)]
    assert got["booths", "booths_creek_format"]["total_computed"] == 22350  # its title is a literal, so both survive
    assert not [k for k in got if k[0] in ("none", "null")]
    assert cl.primary_table(registry.unionByName(found)).where("doc_id = 'full'").first()["pattern_id"] == "full_project_estimate"


def test_loose_cluster(spark):
    docs = spark.createDataFrame([("a", CLUSTER), ("small", CLUSTER.replace(",000", "")), ("same", CLUSTER.replace("Ponds", "Fencing").replace("Terraces", "Fencing")), ("known", CLUSTER)], "doc_id string, text string")
    found = {r["doc_id"]: r for r in cl.loose_clusters(ce.document_lines(docs, keep_blank=True)).collect()}
    assert set(found) == {"a", "known"}
    assert (len(found["a"]["rows"]), found["a"]["total_computed"], found["a"]["total_reported"], found["a"]["pattern_confidence"]) == (3, 9000, 9000, 0.60)
    tables = spark.createDataFrame([("known", "x", 1.0)], "doc_id string, pattern_id string, total_computed double")
    assert {r["doc_id"]: r["pattern_id"] for r in cl.enrich(docs, tables).collect()} == {"known": "x", "a": "aggressive_loose_cluster"}


def test_cluster_signatures(spark):
    text = "\n".join(["Plan", "a $10", "prose", "b $20", "prose", "prose", "c $30", "d $40", "p", "p", "p", "p", "e $50", "Goal", "f $60"])
    found = cl.cluster_signatures(ce.document_lines(spark.createDataFrame([("x", text)], "doc_id string, text string"))).collect()
    assert [(r["start"], r["end"], r["money_lines"], r["signature"]) for r in found] == [(2, 8, 4, "a $10")]
