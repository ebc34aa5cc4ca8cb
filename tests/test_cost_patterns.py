"""One text per kind of cost table: rows, computed and reported totals."""

from __future__ import annotations

import pytest

from siltstone.operators import cost_engine as ce

TEXTS = {
    "booths_creek_bmps": ("Code Practice Units Cost Estimated Units Total\n314 Brush Management ac $44.70            500  $22,350.00\n340 Cover Crop ac $72.93 1,192 $86,932.56\nTotal $109,282.56", 2, 109282.56, 109282.56),
    "bell_creek_bmps": ("Practice Area Affected BMP Cost BMP Total\nStreambank and Shoreline Protection 2,500 feet $69.17/ft $172,904\nWater and Sediment Control Basin 4 structures $10,000/ ea $40,000\nTotal\n$212,904", 2, 212904, 212904),
    "phase1_bmps": ("BMPs Amount Estimated Cost\nSediment Basin 2 each $12,500\nCover Crops 800 ac $58,400\nTotal $70,900", 2, 70900, 70900),
    "practice_unit_nrcs_costs": ("Practice Average Unit NRCS Cost Units Total Cost\nCritical Area Planting $248.10  32 acres $7,939.20\nFence $1.91 12,499 ft $23,873.09\nTOTAL $31,812.29", 2, 31812.29, 31812.29),
    "multi_funding_source_costs": ("Practice Producer NRCS EPA-MDEQ Total\nTail-water Recovery Systems $ 112,500 $ 501,090 $ 110,850 $ 724,440\nLow Grade Weirs $ 26,250 $ - $ 10,000 $ 36,250\nTotals $ 138,750 $ 501,090 $ 120,850 $ 760,690", 2, 760690, 760690),
    "practice_unit_cost_range": ("Practice Unit Cost Number of Units Total Cost\nTerraces $2 - $4 1,000 ft $2,000 - $4,000\nPonds $5,000 - $7,000 10 units $50,000 - $70,000\nTotal $52,000 - $74,000", 2, 63000, 63000),
    "activity_unit_cost_range": ("Activity Unit cost* Number of units Total cost\nFencing $2 - $4 1,000 ft $2,000 - $4,000\nTOTAL $2,000 - $4,000", 1, 3000, 3000),
    "coded_activity_budget_loose": ("A1. - Hire coordinator $1,000\nA2. - Print materials $2,000\nA3. - Hold workshops $3,000\nA4. - Sample water $4,000\nA5. - Report results $5,000\nSubtotal: $15,000", 5, 15000, 30000),
    "implementation_plan_coded_budget": ("Watershed Implementation Plan\nI. Education\nA1. Hire coordinator $1,000\nA2. Print materials $2,000\nSubtotal: $3,000", 2, 3000, 3000),
    "generic_activity_costs": ("Activity Size/Amount Estimated Cost\nFencing 10,000ft @ $2.50 $25,000\nPonds 3 each @ $5,000 $15,000\nTotal Estimated Project Cost $40,000", 2, 40000, 40000),
    "total_estimated_project_cost_block": ("Fencing $25,000 $8,333\nPonds $15,000 $5,000\nTotal Estimated Project Cost $40,000 Match $13,333", 2, 40000, 40000),
    "activity_match": ("Activity Size/Amount Estimated Cost Landowner Match\nFencing 10,000 ft @ $2.50/ft $25,000 $8,333\nTotal Estimated Project Cost $25,000 $8,333", 1, 25000, 25000),
    "practice_costs": ("Practice\nUnit Cost w/Installation\nNumber of Units Total Cost\nWater Control Structures $2,500 40 $100,000\nLarge Overfall\nPipes $5,000 10 $50,000\nTotal\n$150,000", 2, 150000, 150000),
    "tech_assistance": ("Item Cost\nEngineering $5,000\nSurveying $2,500\nTotal $7,500", 2, 7500, 7500),
    "sparse_inline_costs": ("Workshop supplies $100\nProse between the lines.\nField day $200\nMore prose without money.\nSchool program $300\nPrinted brochures $400\nSignage $500", 5, 1500, None),
    "narrative_cost_block": ("Workshop supplies $100\nField day $200\nSchool program $300\nPrinted brochures $400\nNext paragraph.", 4, 1000, None),
    "adaptive_generic_costs": ("Workshop supplies $100 $20\nField day $200\nSchool program $300", 3, 600, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, v[0]) for k, v in TEXTS.items()] + [("none", "Code Practice Units Cost Estimated Units Total\nno rows here"), ("wrapped", "Code Practice Units Cost Estimated Units Total\n327 Conservation Cover  ac $452.43\n1,192  $539,296.56"), ("null", None), ("empty", "")]
    rows.append(("twice", TEXTS["implementation_plan_coded_budget"][0] + "\n" + TEXTS["implementation_plan_coded_budget"][0]))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    return ce.cost_tables(ce.document_lines(docs)).cache()


@pytest.mark.parametrize("pattern", sorted(TEXTS))
def test_pattern(found, pattern):
    _, n, computed, reported = TEXTS[pattern]
    table = found.where((found.doc_id == pattern) & (found.pattern_id == pattern)).orderBy("span_start").first()
    assert table is not None
    assert (len(table["rows"]), table["total_computed"], table["total_reported"]) == (n, computed, reported)
    assert (table["discrepancy"] is None) == (reported is None)


def test_details(found):
    got = {(r["doc_id"], r["pattern_id"]): r for r in found.orderBy(found.span_start.desc()).collect()}
    funding = got["multi_funding_source_costs", "multi_funding_source_costs"]
    assert (funding["producer_computed"], funding["nrcs_computed"], funding["other_computed"]) == (138750, 501090, 120850)
    assert funding["rows"][1]["nrcs"] is None
    assert [r["unit_cost"] for r in got["phase1_bmps", "phase1_bmps"]["rows"]] == [6250, 73]
    assert got["practice_costs", "practice_costs"]["rows"][1]["name"] == "Large Overfall Pipes"
    assert [r["raw_size"] for r in got["generic_activity_costs", "generic_activity_costs"]["rows"]] == ["10,000ft @ $2.50", "3 each @ $5,000"]
    assert {r["section"] for r in got["implementation_plan_coded_budget", "implementation_plan_coded_budget"]["rows"]} == {"I. Education"}
    assert got["total_estimated_project_cost_block", "total_estimated_project_cost_block"]["match_reported"] == 13333
    assert got["activity_match", "activity_match"]["match_discrepancy"] == 0
    assert got["adaptive_generic_costs", "adaptive_generic_costs"]["rows"][0]["extra"] == 20
    assert not [k for k in got if k[0] in ("none", "null", "empty")]
    assert ("wrapped", "booths_creek_bmps") not in got


def test_merge_and_overlap(found):
    merged = ce.merge_coded_budgets(found.where("doc_id = 'twice'")).where("pattern_id = 'implementation_plan_coded_budget'").collect()
    assert len(merged) == 1 and merged[0]["pattern_confidence"] == 0.72
    assert {r["code"] for r in merged[0]["rows"]} == {"A1", "A2"}
    kept = ce.non_overlapping(found).collect()
    by_doc = {}
    for r in kept:
        for s, e in by_doc.setdefault(r["doc_id"], []):
            assert r["span_end"] <= s or e <= r["span_start"]
        by_doc[r["doc_id"]].append((r["span_start"], r["span_end"]))
    rows = ce.cost_rows(found).where("pattern_id = 'multi_funding_source_costs'").collect()
    assert all(abs(r["pct_producer"] + r["pct_nrcs"] + r["pct_other"] - 1) < 1e-9 for r in rows)


def test_names_lose_the_first_run_of_marks_only(spark):
    lines = ["- Fence-line work $100.00", "Stream • bank repair $200.00", "Cover - crop - seed $300.00", "Plain $400.00"]
    found = ce.tables_of(spark.createDataFrame([("d", lines)], "doc_id string, lines array<string>"), next(p for p in ce.PATTERNS if p.id == "narrative_cost_block")).orderBy("span_start").first()
    assert [r["name"] for r in found["rows"]] == ["Fence-line work", "Stream bank repair", "Cover crop - seed", "Plain"]


def test_sparse_costs_end_at_two_blank_lines(spark):
    paid = [f"Work number {x} on the creek ${n}00.00" for n, x in enumerate("abcdefgh", 1)]
    lines = [*paid[:3], "", *paid[3:6], "", "", *paid[6:]]
    found = ce.tables_of(spark.createDataFrame([("d", lines)], "doc_id string, lines array<string>"), next(p for p in ce.PATTERNS if p.id == "sparse_inline_costs")).orderBy("span_start").first()
    assert len(found["rows"]) == 6 and found["total_computed"] == 2100


def test_each_line_is_parsed_once(spark, sf_dir):
    """A row's regular expression stands in a plan once for the window's lines and twice for those behind it, not once per field and use."""
    from siltstone.plans.catalogue import QUERIES

    plan = lambda name: QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for name, test in (("booths_roundtrip", "(ac|ft|ea|each|cuyd|sqft|gal|no)"), ("known_practice_roundtrip", "Critical Area Planting"), ("full_project_roundtrip", "N/A|@"), ("generic_activity_roundtrip", "ponds?)|[0-9][0-9,]*"), ("loose_cluster_roundtrip", "^total")):
        assert 1 <= plan(name).count(test) <= 3, name


def test_a_document_is_looked_at_in_its_row(spark):
    """All patterns, covered tables and overlaps: one scan and no shuffle."""
    docs = spark.createDataFrame([("d", TEXTS["booths_creek_bmps"][0])], "doc_id string, text string")
    plan = ce.cost_tables(ce.document_lines(docs), apart=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan") == 1


def test_tables_go_on_as_long_as_their_rows(spark, tmp_path):
    """Orders of more lines than a window has: each is summed whole, and its total found."""
    from siltstone.plans.catalogue import QUERIES

    sizes = {1: 17, 2: 18, 3: 19, 4: 75}
    rows = [(k, i + 1, 5, i % 7 + 1, 12.0, 100.0 + i) for k, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {k: (n, sum(100.0 + i for i in range(n))) for k, n in sizes.items()}
    for name in ("tech_format_roundtrip", "bell_format_roundtrip", "phase1_roundtrip"):
        got = {r["doc_id"]: r for r in QUERIES[name].run(spark, str(tmp_path)).collect()}
        assert {k: (r["n_rows"], r["total_computed"]) for k, r in got.items()} == want, name
        assert all(r["total_reported"] == want[k][1] and r["discrepancy"] == 0 for k, r in got.items()), name


def test_a_window_ends_where_rows_do(spark):
    lines = ["Item Cost", *[f"Work {i} ${i}00" for i in range(1, 10)], *["Prose."] * 20, "Later $5", "Total $9"]
    found = ce.tables_of(spark.createDataFrame([("d", lines)], "doc_id string, lines array<string>"), next(p for p in ce.PATTERNS if p.id == "tech_assistance")).first()
    assert len(found["rows"]) == 9 and found["total_reported"] is None
