"""The older kinds of cost tables, found besides the registry, and loose clusters for documents without any.

They are patterns like the registry's, with other windows, names and
confidences; where a registry table has the same columns and title, the older
one is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import HAS_MONEY, amounts, bound, size_parts, trimmed
from siltstone.operators import cost_engine as ce
from siltstone.operators.cost_engine import Pattern, count_ahead, dollar, first_index, kept_rows, matches

# What heads the older kinds, and the practices they know.
PRACTICES = r"(?i)\b(Fencing|Water Facilities|Heavy Use Areas|Stream Crossings|Ponds|Sediment Basins|Nutrient Management|Critical Area Planting|Establishment|Forage|Biomass|Education|Monitoring|Project Management)\b"
FULL, PHASE = r"(?i)^\s*Cost Estimate:\s*Full Project Implementation", r"(?i)^\s*Cost Estimate:\s*Phase 1 Implementation"
FUNDED_HEAD = r"(?i)Table.*Funded.*319.*Project.*Budget.*BMPs|Practice\s+Area Affected\s+BMP Cost\s+BMP Total"
TOTAL = r"(?i)Total Estimated (?:Phase 1 )?Cost"

#: Columns of a pattern's table; equal columns and title make two tables the same.
COLUMNS = {
    "activity_match": "activity|size/amount|estimated cost|landowner match", "practice_costs": "practice|unit cost w/installation|number of units|total cost", "bell_creek_bmps": "practice|area affected|bmp cost|bmp total",
    "tech_assistance": "item|cost", "phase1_bmps": "bmps|amount|estimated cost", "booths_creek_bmps": "code|practice|units|cost|estimated units|total",
}
SAME_AS = {"activity_match_format": "activity_match", "practice_costs_format": "practice_costs", "bell_creek_format": "bell_creek_bmps", "tech_assistance_format": "tech_assistance", "phase1_bmps_format": "phase1_bmps", "booths_creek_format": "booths_creek_bmps"}
#: Titles that do not come from the head line.
TITLES = {"practice_costs_format": "Projected Costs for Agricultural BMPs", "bell_creek_format": "Bell Creek BMP Budget", "phase1_bmps_format": "Phase 1 Implementation BMPs", "booths_creek_format": "BMP Cost Estimates"}

BY_ID = {p.id: p for p in ce.PATTERNS}


def _known_practice(line: Column) -> Column:
    """Rows of known practices, with quantity, unit and unit cost out of their size."""
    def sized(row: Column) -> Column:
        total = lambda size: F.coalesce(F.nullif(row["total_cost"], F.lit(0.0)), size["quantity"] * size["unit_cost"])
        put = lambda size: row.withField("quantity", size["quantity"]).withField("unit", size["unit"]).withField("unit_cost", size["unit_cost"]).withField("total_cost", total(size))
        return F.when(row.isNotNull(), bound(size_parts(row["raw_size"]), put))

    return F.when(line.rlike(PRACTICES), bound(ce._match_row(line), sized))


def _estimate_row(line: Column) -> Column:
    """Name, size and the last amount of a line; long names without a size are prose."""
    left = F.trim(F.regexp_replace(line, r"\$[0-9][0-9,]*(?:\.[0-9]{2})?[^$]*$", ""))

    def costed(values: Column, name: Column, size: Column, parts: Column) -> Column:
        total = F.coalesce(F.nullif(F.element_at(values, -1), F.lit(0.0)), parts["quantity"] * parts["unit_cost"])
        return ce.row_struct(name=name, raw_size=size, total_cost=total, quantity=parts["quantity"], unit=parts["unit"], unit_cost=parts["unit_cost"])

    def named(values: Column, name: Column, size: Column) -> Column:
        prose = (F.size(F.split(name, r"\s+")) > 10) & ~size.contains("@") & ~size.rlike(r"\b[0-9]")
        return F.when((name != "") & ~name.rlike("(?i)^Total Estimated") & ~prose, bound(size_parts(size), lambda parts: costed(values, name, size, parts)))

    def found(values: Column) -> Column:
        build = lambda name, size: bound(F.trim(F.regexp_replace(name, r"\*+$", "")), lambda n: bound(size, lambda z: named(values, n, z)))
        return F.when(F.size(values) > 0, bound(left, lambda x: ce.split_at(x, r"(?i)(\b[0-9][0-9,]*\b|N/A|@)", build)))

    return F.when(line.contains("$"), bound(amounts(line), found))


def _distinct_rows(body: Column, rows: Column) -> Column:
    """Rows behind the column heads, the first of each name."""
    def first_each(kept: Column) -> Column:
        names = F.transform(kept, lambda r: F.lower(r["name"]))
        return bound(names, lambda ns: F.filter(kept, lambda r, i: F.array_position(ns, F.get(ns, i)) == i + 1))

    heads = first_index(body, lambda x: x.rlike(r"(?i)BMPs\*") & x.rlike("(?i)Size/Amount"))
    behind = bound(heads, lambda h: F.filter(F.slice(rows, h + 1, F.size(body)), lambda r: r.isNotNull()))
    return bound(behind, first_each)


def _estimate(id: str, confidence: float | None, head: str) -> Pattern:
    return Pattern(
        id, confidence or 0.0, ce._said(head), 109, _estimate_row, gate=head, stop=matches(rf"{TOTAL}|^Element\s+[a-i]:"), rows=_distinct_rows,
        reported=ce.on_stop(ce.first_amount, TOTAL), computed_zero_is_null=True,
    )


TABLE_HEAD = "(?i)Table.*Agricultural.*Best Management Practice"
LEGACY: Sequence[Pattern] = (
    replace(BY_ID["activity_match"], id="activity_match_format", confidence=0.70, heads=ce._said("(?i)Activity.*Size.*Amount.*Estimated Cost.*Landowner Match"), row=_known_practice),
    replace(
        BY_ID["practice_costs"], id="practice_costs_format", confidence=0.75, gate=f"{ce.PRACTICE_LINE}|{TABLE_HEAD}",
        heads=ce._either(ce._near_lines(ce.PRACTICE_LINE, 6, "(?i)Unit Cost", "(?i)Total Cost"), ce._near_lines(TABLE_HEAD, 10, "(?i)Practice.*Unit Cost.*Total Cost")),
    ),
    replace(BY_ID["bell_creek_bmps"], id="bell_creek_format", confidence=0.85, reach=39, gate=FUNDED_HEAD, heads=ce._said(FUNDED_HEAD)),
    replace(BY_ID["tech_assistance"], id="tech_assistance_format", confidence=0.60, reach=19, heads=ce._near_lines("(?i)Table.*Technical Assistance", 20, r"(?i)Item\s+Cost")),
    replace(BY_ID["phase1_bmps"], id="phase1_bmps_format", confidence=0.80, reach=29),
    replace(BY_ID["booths_creek_bmps"], id="booths_creek_format", confidence=0.85, reach=49, computed_zero_is_null=False, stop=matches(r"(?i)^Total\s*\$[0-9]|In addition to these costs|Element|Activity.*Estimated Cost")),
    _estimate("full_project_estimate", 0.65, FULL),
    _estimate("phase1_estimate", 0.65, PHASE),
)
GENERIC = _estimate("generic_estimate", None, "(?i)cost estimate")
GENERIC = replace(GENERIC, heads=ce.first_of(GENERIC.heads))


def _columns(pattern_id: Column) -> Column:
    """The columns of a pattern's table, of either kind; null where they are not known."""
    kinds = COLUMNS | {old: COLUMNS[new] for old, new in SAME_AS.items()}
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[pattern_id]


def older_tables(lines: Column, text: Column) -> Column:
    """array<struct<t, title, ...>> of the older kinds in a document's lines, whatever else was found there."""
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    entitled = lambda x: F.coalesce(titles[x["t"]["pattern_id"]], x["title"])
    found = bound(ce.all_of([ce.gated(lines, text, p) for p in LEGACY]), lambda tables: ce.spanned(lines, tables))
    return F.transform(found, lambda x: x.withField("title", entitled(x)))


def generic_table(lines: Column, text: Column) -> Column:
    """The first line with a cost estimate as a table without a kind."""
    found = bound(ce.gated(lines, text, GENERIC), lambda tables: ce.spanned(lines, tables))
    bare = lambda t: F.struct(*[(F.lit(None).cast(k) if n in ("pattern_id", "pattern_confidence") else t[n]).alias(n) for n, k in (("pattern_id", "string"), ("pattern_confidence", "double"), *[(x, None) for x in ("at", "rows", "total_computed", "total_reported", "match_reported")])])
    return F.transform(found, lambda x: F.struct(bare(x["t"]).alias("t"), *[x[n].alias(n) for n in ("title", "span_end", "dollar_lines")]))


def _text(lines: Column) -> Column:
    return F.when(F.exists(lines, lambda x: x.contains("$")), F.array_join(lines, "\n"))


def every_table(lined: DataFrame) -> DataFrame:
    """The registry's and the older tables of (doc_id, lines), found and compared in each document's row: :func:`legacy_tables` with them."""
    lines, text = F.col("lines"), F.col("_text")
    sign = lambda x: F.struct(_columns(x["t"]["pattern_id"]).alias("c"), x["title"].alias("t"))
    known = lambda x: F.coalesce(F.array_contains("_signs", sign(x)), F.lit(False))
    # step by step, as one expression of all of it is nested deeper than the analyzer goes
    found = lined.select("doc_id", "lines", _text(lines).alias("_text"), ce.registry_tables(lines, ce.PATTERNS).alias("_new"))
    found = found.withColumn("_signs", F.transform("_new", sign)).withColumn("_old", F.when(text.isNotNull(), older_tables(lines, text)))
    joined = ce.all_of([F.col("_new"), F.filter("_old", lambda x: ~known(x))])
    # no column of its own is exploded: the filter inferred from it would compute it again
    every = bound(joined, lambda tables: F.when(F.size(tables) > 0, tables).when(text.isNotNull(), generic_table(lines, text)))
    flat = found.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.title", "x.span_end", "x.dollar_lines", "x.t")
    return ce.measured(flat, (*ce.PATTERNS, *LEGACY))


def legacy_tables(lined: DataFrame, registry: DataFrame) -> DataFrame:
    """Older kinds in (doc_id, lines) that the registry's tables do not have; a document with no table at all is tried as a generic estimate."""
    flat = lambda docs, find: docs.select("doc_id", F.explode(bound(_text(F.col("lines")), lambda text: F.when(text.isNotNull(), find(F.col("lines"), text)))).alias("x")).select("doc_id", "x.title", "x.span_end", "x.dollar_lines", "x.t")
    found = ce.measured(flat(lined, older_tables), LEGACY).withColumn("_c", _columns(F.col("pattern_id")))
    signed = registry.select("doc_id", _columns(F.col("pattern_id")).alias("_c"), F.col("title").alias("_t")).where("_c is not null").distinct()
    found = found.join(signed, (found["doc_id"] == signed["doc_id"]) & (found["_c"] == signed["_c"]) & (found["title"] == signed["_t"]), "left_anti").drop("_c")
    none = lined.join(registry.select("doc_id").union(found.select("doc_id")).distinct(), "doc_id", "left_anti")
    return found.unionByName(ce.measured(flat(none, generic_table), LEGACY))


def primary_table(tables: DataFrame) -> DataFrame:
    """Per document the full-project estimate if there is one, else the first table."""
    order = [(F.col("pattern_id") == "full_project_estimate").desc_nulls_last(), F.col("span_start"), F.col("pattern_id")]
    return tables.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where("_n = 1").drop("_n")


# --- loose clusters ---


def money_runs(lines: Column) -> Column:
    """Maximal runs of lines with an amount, as array<struct<start, n>> (0-based)."""
    def runs(paid: Column) -> Column:
        edges = lambda step: F.filter(F.transform(paid, lambda x, i: F.when(x & ~F.coalesce(F.get(paid, i + step), F.lit(False)), i)), lambda i: i.isNotNull())
        return bound(edges(1), lambda ends: F.transform(edges(-1), lambda s, k: F.struct(s.alias("start"), (F.get(ends, k) - s + 1).alias("n"))))

    return bound(F.transform(lines, dollar), runs)


def loose_clusters(lined: DataFrame, *, least_rows: int = 3, least_sum: float = 5000.0, most_repeated: float = 0.6) -> DataFrame:
    """Tables of runs of amount lines in (doc_id, lines, blank ones kept), for documents without a table.

    Cells are parted by tabs or several blanks and the amount must be in the
    last one; too few rows or dollars, or a first cell that repeats too often,
    make a run prose.
    """
    lines = F.col("lines")

    def row(line: Column, tabbed: Column) -> Column:
        cells = F.filter(F.transform(F.when(tabbed, F.split(line, r"\t+")).otherwise(F.split(line, " {2,}")), lambda c: F.trim(c)), lambda c: c != "")

        def celled(cells: Column) -> Column:
            last = F.get(cells, F.size(cells) - 1)
            middle = F.when(F.size(cells) > 2, F.array_join(F.slice(cells, F.lit(2), F.greatest(F.lit(0), F.size(cells) - 2)), " ")).otherwise(F.lit(""))
            return F.when(last.rlike(HAS_MONEY) & ~line.rlike("(?i)^total"), ce.row_struct(name=F.get(cells, F.lit(0)), raw_size=middle, total_cost=ce.first_amount(last), raw_cost=last))

        return bound(cells, celled)

    def cluster(r: Column) -> Column:
        def kept(own: Column, rows: Column) -> Column:
            total = ce.total_of(rows, "total_cost")
            names = F.transform(rows, lambda r: F.lower(r["name"]))
            repeated = bound(names, lambda ns: F.array_max(F.transform(F.array_distinct(ns), lambda x: F.size(F.filter(ns, lambda y: y == x)))))
            distinct = F.size(F.array_distinct(F.flatten(F.transform(own, amounts))))
            good = lambda total: (F.size(rows) >= least_rows) & (total >= least_sum) & (distinct >= 2) & (repeated <= most_repeated * F.size(rows))
            return bound(total, lambda t: F.when(good(t), F.struct(r["start"].alias("start"), rows.alias("rows"), t.alias("total"))))

        own = F.slice(lines, r["start"] + 1, F.least(F.lit(40), r["n"]))
        return bound(own, lambda own: bound(F.exists(own, lambda x: x.contains("\t")), lambda tabbed: bound(kept_rows(own, lambda x: row(x, tabbed)), lambda rows: kept(own, rows))))

    found = F.filter(F.transform(F.filter(money_runs(lines), lambda r: r["n"] >= 3), cluster), lambda t: t.isNotNull())
    runs = lined.select("doc_id", "lines", F.explode(found).alias("t")).select("doc_id", "lines", "t.start", "t.rows", F.col("t.total").alias("total_computed"))
    ahead = F.slice("lines", F.col("start") + F.size("rows") + 1, F.lit(5))
    reported = ce.first_amount(F.get(F.filter(ahead, lambda x: x.rlike("(?i)total") & dollar(x)), F.lit(0)))
    before = F.slice("lines", F.greatest(F.lit(1), F.col("start") - 2), F.least(F.lit(3), F.col("start")))
    headed = F.exists(before, lambda x: x.rlike("(?i)(cost|estimate|budget|practice|bmp|activity|item)"))
    runs = runs.select("doc_id", F.when(headed, 0.60).otherwise(0.55).alias("pattern_confidence"), "start", "rows", reported.alias("total_reported"), "total_computed")
    return runs.select(
        "doc_id", F.lit("aggressive_loose_cluster").alias("pattern_id"), "pattern_confidence", F.lit("Loose Cost Cluster").alias("title"), F.col("start").alias("span_start"),
        "rows", "total_reported", "total_computed", ce.cents(F.col("total_reported") - F.col("total_computed")).alias("discrepancy"),
    )


def enrich(documents: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with loose clusters added for the documents (doc_id, text) that have none, largest first."""
    bare = documents.join(tables.select("doc_id").distinct(), "doc_id", "left_anti")
    found = loose_clusters(ce.document_lines(bare, keep_blank=True))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("total_computed").desc(), "span_start"))
    return tables.unionByName(found.withColumn("table_id", F.concat(F.lit("aggressive_cluster_"), n.cast("string"))), allowMissingColumns=True)


def cluster_signatures(lined: DataFrame, *, least: int = 4, ahead: int = 80, reach: int = 120, gap: int = 3) -> DataFrame:
    """(doc_id, start, end, money_lines, signature): stretches of amount lines with at most ``gap`` others between, greedily from the top."""
    breaks = r"(?i)^(?:Goal|Objective|Section|Table\s+\d+|Implementation Plan)"
    lines = F.col("lines")
    starts = F.filter(F.transform(lines, lambda x, i: F.when(dollar(x), i)), lambda i: i.isNotNull())

    def end_of(i: Column) -> Column:
        window = F.slice(lines, i + 1, F.lit(reach))
        cut = first_index(window, matches(breaks))
        window = F.when(cut > 0, F.slice(window, F.lit(1), cut - 1)).otherwise(window)
        hits = F.filter(F.transform(window, lambda x, k: F.when(dollar(x), k)), lambda k: k.isNotNull())
        return i + F.aggregate(hits, F.lit(0), lambda last, k: F.when(k - last <= gap + 1, k).otherwise(last))

    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(found: Column, i: Column) -> Column:
        free = i > F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))), found), -1)["e"], F.lit(-1))
        end = end_of(i)
        return F.when(free & (count_ahead(lines, i, 0, ahead, dollar) >= least) & (end > i), F.concat(found, F.array(F.struct(i.alias("s"), end.alias("e"))))).otherwise(found)

    found = lined.select("doc_id", "lines", F.explode(F.aggregate(starts, empty, step)).alias("c"))
    own = F.filter(F.slice("lines", F.col("c.s") + 1, F.col("c.e") - F.col("c.s") + 1), dollar)
    signature = F.substring(trimmed(F.regexp_replace(F.get(own, F.lit(0)), r"\s+", " ")), 1, 120)
    return found.select("doc_id", (F.col("c.s") + 1).alias("start"), (F.col("c.e") + 1).alias("end"), F.size(own).alias("money_lines"), signature.alias("signature"))
