"""From documents to reports: every entity table of a corpus, the report summary, and the service calls on them.

``Corpus`` holds one DataFrame per entity.  A document's section lines stay in its
own row, written once to the shared folder: goals, practices and tables take their
lines from that array without a shuffle.  The lines of documents that have an
amount at all are written too: the many patterns of cost tables then scan that
small table instead of sectioning the corpus again each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import from_starter
from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.operators import cost_legacy as cl
from siltstone.operators import entities as en
from siltstone.operators import lines as ln
from siltstone.operators.paragraphs import reconstruct
from siltstone.sources.shared import written

Classifier = Callable[[DataFrame], DataFrame]


@dataclass
class Corpus:
    documents: DataFrame
    sections: DataFrame
    goals: DataFrame
    practices: DataFrame
    rejected: DataFrame | None
    activities: DataFrame
    implementation: DataFrame
    monitoring: DataFrame
    outreach: DataFrame
    geography: DataFrame
    cost_tables: DataFrame


def lines_of(*names: str) -> Column:
    """The lines of the named sections, one section behind the other, from a row with ``sections``."""
    of = lambda name: F.transform(F.filter("sections", lambda x: x["section"] == name), lambda x: x["line"])
    return F.concat(*[of(n) for n in names])


def sectioned(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, text, sections): a document's section lines in its own row.

    A classifier sees (doc_id, section, section_rank, pos, line) and may give lines another section.
    """
    rows = documents.select("doc_id", "text")
    if not classifier:
        return rows.withColumn("sections", ln.sections_of(F.col("text")))
    moved = classifier(ln.section_lines(rows, "doc_id", "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section", "line"))).alias("_s"))
    ordered = F.transform("_s", lambda x: F.struct(x["section"].alias("section"), x["pos"].alias("pos"), x["line"].alias("line")))
    return rows.join(moved, "doc_id", "left").select("doc_id", "text", F.coalesce(ordered, F.array().cast("array<struct<section:string,pos:int,line:string>>")).alias("sections"))


def section_rows(base: DataFrame) -> DataFrame:
    """(doc_id, section, section_rank, pos, line) of rows with ``sections``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ln.SECTIONS]), F.col("section")).cast("int") - 1
    return base.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section", "s.pos", "s.line").withColumn("section_rank", rank)


def augmented(lines: Column, raw: Column) -> Column:
    """Lines; where the funding header is only in the raw ones, the 26 raw lines around it go behind."""
    header = ce.matches(ce.FUNDING_HEAD)
    at = ce.first_index(raw, header)
    return F.when(~F.exists(lines, header) & (at > 0), F.concat(lines, F.slice(raw, F.greatest(F.lit(1), at - 1), F.lit(26)))).otherwise(lines)


def report_goals(base: DataFrame) -> DataFrame:
    """Goals of (doc_id, text, sections): the known raw sentence, else the chain over the goal lines, else the fallbacks."""
    every = lines_of(*ln.SECTIONS)
    sole = en.sole(en.canonical_goal(F.col("text")), 0.95, "bronze_direct_slice")
    lines = lines_of("Goals")
    broken = F.exists(lines, lambda x: F.trim(x).rlike(en.BROKEN_LINE))
    rows = base.select("doc_id", sole.alias("sole"), en.goal_lines(lines, every).alias("lines"), F.when(broken, en.repaired_goal(F.col("text"))).alias("repair"), en.fallback_lines(lines_of, every).alias("stages"))
    rows = written(rows, "goal-sources")
    open_ = rows.where("sole IS NULL")
    found = written(en.extracted_goals(open_.where(F.size("lines") > 0).select("doc_id", "lines"), written), "extracted-goals")
    found = en.repair_single(found, open_).withColumn("fallback", F.lit(False))
    bare = open_.where(F.size("stages") > 0).join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    spare = en.fallback_goals(bare.select("doc_id", "stages"), written).drop("stage").withColumn("fallback", F.lit(True))
    goals = written(found.unionByName(spare).unionByName(en.sole_goals(rows).withColumn("fallback", F.lit(False))), "report-goals")
    unended = goals.where(~F.col("title").rlike(r"[.!?]$")).select("doc_id", "id", "title")
    repaired = reconstruct(unended.join(rows.select("doc_id", "lines"), "doc_id"))
    goals = goals.join(repaired.drop("title"), ["doc_id", "id"], "left")
    longer = F.coalesce("full_paragraph", "full_title")
    whole = F.when(F.length(longer) > F.length("title"), longer).otherwise(F.col("title"))
    return goals.withColumn("original_sentence", F.col("title")).withColumn("description", from_starter(whole))


def report_practices(base: DataFrame, cost_rows: DataFrame | None, *, noise_filter: bool = True, refine_categories: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(practices, rejected) of (doc_id, text, sections): section lines, cost rows if given, summary lines where few, cleaned and numbered."""
    found = en.practices(base.select("doc_id", lines_of("BMPs").alias("lines")))
    if refine_categories:
        found = en.refined(found)
    if cost_rows is not None:
        found = en.injected_cost_rows(cost_rows, found)
    found = written(found, "practices")
    found = en.summary_line_practices(base.select("doc_id", F.posexplode(lines_of(*ln.SECTIONS)).alias("pos", "line")), found)
    rejected = None
    if noise_filter:
        found = written(found, "practices-summed")
        found, rejected = en.filter_practices(found)
    found = written(en.trimmed_names(en.both_sources(found)), "practices-cleaned")
    bare = base.where(F.size(lines_of("BMPs")) == 0).select("doc_id", en.listed_practices(F.col("text")).alias("names")).where(F.size("names") > 0)
    listed = bare.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.posexplode("names").alias("pos", "name"))
    listed = listed.select("*", F.lit("General").alias("category"), F.lit(0.22).alias("confidence"), F.lit("bronze_fallback:list").alias("source"))
    return en.numbered(found.unionByName(listed, allowMissingColumns=True), "B"), rejected


def report_tables(base: DataFrame, *, non_overlapping: bool = False) -> DataFrame:
    """Cost tables of (doc_id, text, sections): every pattern and older kind on the lines that have amounts."""
    raw = ce.raw_lines(F.col("text"))
    ordered = base.where(F.col("text").contains("$")).select("doc_id", ln.completed(augmented(lines_of(*ln.SECTIONS), raw), raw).alias("lines"))
    tables = ce.merge_coded_budgets(written(cl.every_table(ordered), "all-tables"))
    return ce.non_overlapping(tables) if non_overlapping else tables


def process(
    documents: DataFrame, *, noise_filter: bool = True, refine_categories: bool = False, inject_cost_rows: bool = False, classifier: Classifier | None = None, non_overlapping: bool = False,
) -> Corpus:
    """Everything that is extracted from (doc_id, text).

    ``classifier`` may move uncategorized section lines; none is needed.  The
    options follow what deployments switch: the noise filter is on by default,
    finer categories, practices from cost rows and overlap-free tables are not.
    """
    base = written(sectioned(documents, classifier), "sections")
    sections = section_rows(base)
    tables = report_tables(base, non_overlapping=non_overlapping)
    rows = table_names(tables) if inject_cost_rows else None
    practices, rejected = report_practices(base, rows, noise_filter=noise_filter, refine_categories=refine_categories)
    activities = written(en.numbered(en.activities(base.select("doc_id", lines_of("Implementation").alias("lines"))), "A"), "activities")
    return Corpus(
        documents, sections, written(report_goals(base), "goals"), written(practices, "practices"), rejected, activities, en.implementation(activities), en.plain_section(sections, "Monitoring", "M", "metric"),
        en.plain_section(sections, "Outreach", "O", "activity"), en.plain_section(sections, "Geography", "GA", "area"), tables,
    )


def table_names(tables: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, place, name) of every table row."""
    return tables.select("doc_id", "pattern_id", "span_start", F.posexplode("rows").alias("n", "r")).select("doc_id", "pattern_id", (F.coalesce("span_start", F.lit(0)) * 1000 + F.col("n")).alias("place"), F.col("r.name").alias("name"))


def enriched(corpus: Corpus) -> Corpus:
    """The corpus after the later passes over documents without cost tables.

    Second pass: their text sectioned by cost cues, then all their lines, through
    the patterns; third pass: loose clusters, largest first.  Names of rows that
    the passes found, and practices lack, become practices of low confidence.
    """
    bare = corpus.documents.select("doc_id", "text").join(corpus.cost_tables.select("doc_id").distinct(), "doc_id", "left_anti")
    cued = written(ln.cost_lines(bare).where(F.exists("lines", lambda x: x.contains("$"))), "cued-lines")
    again = written(ce.cost_tables(cued), "second-pass")
    left = written(ce.document_lines(bare.join(again.select("doc_id").distinct(), "doc_id", "left_anti")).where(F.exists("lines", lambda x: x.contains("$"))), "all-lines")
    again = again.unionByName(written(ce.cost_tables(left), "second-pass-all")).withColumn("enriched", F.lit(True))
    tables = corpus.cost_tables.unionByName(again, allowMissingColumns=True)
    tables = written(cl.enrich(corpus.documents.select("doc_id", "text"), tables), "enriched-tables")
    added = en.practices_from_costs(table_names(tables), corpus.practices).withColumn("pos", F.lit(2 * en.BEHIND))
    return replace(corpus, cost_tables=tables, practices=en.numbered(corpus.practices.drop("id").unionByName(added, allowMissingColumns=True), "B", ("pos", "name")))


#: The entity tables whose rows are looked up in the text, and the column with what is looked up.
PRESENCE = (("goals", "title"), ("practices", "name"), ("implementation", "description"), ("monitoring", "metric"), ("outreach", "activity"))


def with_presence(corpus: Corpus, entity: str) -> DataFrame:
    """An entity table with ``present``: whether the text has it, case aside."""
    return an.contained_in(getattr(corpus, entity), corpus.documents, "doc_id", dict(PRESENCE)[entity], "text")


def summary(corpus: Corpus) -> DataFrame:
    """Per document: counts, completion, confidence, categories and what was found present in the text."""
    goals = an.report_summary(corpus.goals, "doc_id")
    by_category = corpus.practices.groupBy("doc_id", "category").agg(F.count("*").alias("n"))
    categories = by_category.groupBy("doc_id").agg(F.sum("n").alias("practices"), F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("categories"))
    acts = corpus.activities.groupBy("doc_id").agg(F.count("*").alias("activities"))
    costs = an.report_list(corpus.cost_tables.select(F.col("doc_id").alias("report_id"), "pattern_id", F.col("total_reported").alias("reported"), F.col("total_computed").alias("computed"))).withColumnRenamed("report_id", "doc_id")
    # one look at each text for all entities
    named = None
    for entity, column in PRESENCE:
        part = getattr(corpus, entity).select("doc_id", F.lit(entity).alias("entity"), F.col(column).alias("what"))
        named = part if named is None else named.unionByName(part)
    present = an.contained_in(named, corpus.documents, "doc_id", "what", "text").where("present").groupBy("doc_id").agg(*[an.count_if(F.col("entity") == e).alias(f"{e}_present") for e, _ in PRESENCE])
    whole = corpus.documents.select("doc_id")
    for part in (goals, categories, acts, costs, present):
        whole = whole.join(part, "doc_id", "left")
    return whole.fillna(0, ["total", "practices", "activities", "completion_rate", "avg_confidence", "strong", *[f"{e}_present" for e, _ in PRESENCE]])


def get_report(corpus: Corpus, doc_id) -> dict[str, DataFrame]:
    """Every entity table of one document."""
    only = lambda d: d.where(F.col("doc_id") == doc_id)
    names = ("goals", "practices", "activities", "implementation", "monitoring", "outreach", "geography", "cost_tables")
    return {n: only(getattr(corpus, n)) for n in names}


def nested_reports(corpus: Corpus) -> DataFrame:
    """One row per document with arrays of goals, practices and cost tables."""
    whole = summary(corpus)
    for name, table, order in (("goals", corpus.goals, "id"), ("practices", corpus.practices, "id"), ("cost_tables", corpus.cost_tables.drop("dollar_lines"), "span_start")):
        fields = [c for c in table.columns if c not in ("doc_id", order)]
        rows = F.array_sort(F.collect_list(F.struct(order, F.to_json(F.struct(*fields)).alias("fields"))))
        whole = whole.join(table.groupBy("doc_id").agg(rows.alias(f"{name}_list")), "doc_id", "left")
    return whole
