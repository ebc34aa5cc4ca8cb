"""The line model: lines of documents, sections, runs, windows and reconstruction.

Where a rule looks only inside one document it works on the array of the
document's lines, in the row itself.  Where a caller has lines (or any ordered
rows) as a table, the window forms do the same with one exchange on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import HAS_MONEY, trimmed

#: Section names in the order in which their lines are put together.
SECTIONS = ("Goals", "BMPs", "Implementation", "Monitoring", "Outreach", "Geography", "uncategorized")

# Cues of lines that belong to cost tables.
COST_HEADS = r"(?i)Estimated\s+Cost|Total\s+Cost|Unit\s+Cost|Landowner\s+Match|Cost\s+Estimate|Projected\s+Costs"


def explode_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, line) for every line; an empty text has one empty line."""
    return docs.select(F.col(id_col), F.posexplode(F.split(text_col, r"\r?\n")).alias("pos", "line"))


def sections_of(text: Column) -> Column:
    """array<struct<section, pos, line>>: each non-blank line with the last header before it.

    A header is a line that is a section's name, case aside, with one colon at most.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), trimmed), lambda x: x != "")
    names = F.create_map(*[F.lit(x) for s in SECTIONS[:-1] for x in (s.lower(), s)])
    longest = max(map(len, SECTIONS[:-1])) + 1
    header = lambda line: F.when(F.length(line) <= longest, names[F.regexp_replace(F.lower(line), ":$", "")])
    marked = F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), header(x).alias("header")))

    def cut(rows: Column) -> Column:
        """Stretches between headers: few, so that the fold over them stays short whatever the number of lines."""
        heads = F.filter(rows, lambda r: r["header"].isNotNull())
        first = F.struct(F.lit(-1).alias("at"), F.lit("").alias("line"), F.lit("uncategorized").alias("header"))
        starts = F.concat(F.array(first), heads)
        ends = F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1)["at"], F.size(rows)))
        # of i headers before a line, its place among the kept lines is its own minus i
        own = lambda s, i: F.transform(F.slice(rows, s["at"] + 2, F.greatest(F.lit(0), F.get(ends, i) - s["at"] - 1)), lambda r: F.struct(s["header"].alias("section"), (r["at"] - i).alias("pos"), r["line"].alias("line")))
        return F.flatten(F.transform(starts, own))

    # a one-element transform names the marked lines, so that they are computed once
    return F.get(F.transform(F.array(marked), cut), F.lit(0))


def section_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sections) of every document, see :func:`sections_of`."""
    return docs.select(F.col(id_col), sections_of(F.col(text_col)).alias("sections"))


def section_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, section_rank, pos, line), pos counting the kept lines of the document."""
    flat = section_arrays(docs, id_col, text_col).select(F.col(id_col), F.explode("sections").alias("s")).select(F.col(id_col), "s.*")
    rank = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int") - 1
    return flat.select(F.col(id_col), "section", rank.alias("section_rank"), "pos", "line")


def carry_forward(rows: DataFrame, key: str, order: Sequence[str], value: Column, name: str, default: str | None = None) -> DataFrame:
    """Adds the last non-null value so far within the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(value, ignorenulls=True).over(w)
    return rows.withColumn(name, carried if default is None else F.coalesce(carried, F.lit(default)))


def cue_sections(docs: DataFrame, id_col: str, text_col: str, *, goal_cap: int = 50, uncategorized: bool = True) -> DataFrame:
    """The batch sectioniser: goal lines (the first ``goal_cap``) and, apart from that, cost lines; others uncategorized."""
    lines = explode_lines(docs, id_col, text_col).withColumn("line", trimmed(F.col("line"))).where("line != ''")
    goal, cost = F.col("line").rlike(r"(?i)\bgoal\b"), F.col("line").rlike(HAS_MONEY) | F.col("line").rlike(COST_HEADS)
    kinds = F.array_compact(F.array(F.when(goal, F.lit("Goals")), F.when(cost, F.lit("BMPs")), F.when(~goal & ~cost & F.lit(uncategorized), F.lit("uncategorized"))))
    found = lines.select(F.col(id_col), "pos", "line", F.explode(kinds).alias("section"))
    n = F.row_number().over(Window.partitionBy(id_col, "section").orderBy("pos"))
    return found.withColumn("_n", n).where((F.col("section") != "Goals") | (F.col("_n") <= goal_cap)).drop("_n")


def cost_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The enrichment sectioniser: lines with an amount or a cost heading are BMPs, others uncategorized."""
    lines = explode_lines(docs, id_col, text_col).withColumn("line", trimmed(F.col("line"))).where("line != ''")
    return lines.withColumn("section", F.when(F.col("line").rlike(HAS_MONEY) | F.col("line").rlike(COST_HEADS), "BMPs").otherwise("uncategorized"))


def cost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lines) in the order of the enrichment sectioniser: cost lines first, the others behind them."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\r?\n"), trimmed), lambda x: x != "")
    cost = lambda x: x.rlike(HAS_MONEY) | x.rlike(COST_HEADS)
    return docs.select(id_col, F.concat(F.filter(lines, cost), F.filter(lines, lambda x: ~cost(x))).alias("lines"))


def density(rows: DataFrame, key: str, order: Sequence[str], test: Column, ahead: int, name: str = "density") -> DataFrame:
    """Adds how many of the row and the ``ahead`` ones behind it pass."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(0, ahead)
    return rows.withColumn(name, F.sum(test.cast("int")).over(w).cast("long"))


def islands(rows: DataFrame, key: str, order: Sequence[str], test: Column, least: int = 1, largest_gap: int = 1) -> DataFrame:
    """(key, start, end, n): runs of passing rows; up to ``largest_gap`` - 1 others may lie between two.

    Positions count the key's rows from 0.
    """
    w = Window.partitionBy(key).orderBy(*order)
    hits = rows.select(F.col(key), *[F.col(o) for o in order if o != key], (F.row_number().over(w) - 1).alias("_p"), test.alias("_t")).where("_t")
    w2 = Window.partitionBy(key).orderBy("_p")
    fresh = F.coalesce((F.col("_p") - F.lag("_p").over(w2) > largest_gap).cast("int"), F.lit(1))
    grouped = hits.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.groupBy(key, "_g").agg(F.min("_p").cast("long").alias("start"), F.max("_p").cast("long").alias("end"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_g")


def lookahead_text(rows: DataFrame, key: str, order: Sequence[str], text: str, n: int, name: str = "ahead") -> DataFrame:
    """Adds the texts of the row and the n - 1 behind it, joined by blanks."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(0, n - 1)
    return rows.withColumn(name, F.array_join(F.collect_list(text).over(w), " "))


def next_value(rows: DataFrame, key: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the first non-null value behind the row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(value, ignorenulls=True).over(w))


def context(rows: DataFrame, key: str, order: Sequence[str], text: str, test: Column, around: int = 5) -> DataFrame:
    """Rows that pass, with ``snippet``: the texts from ``around`` before to ``around`` behind."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-around, around)
    return rows.withColumn("snippet", F.array_join(F.collect_list(text).over(w), "\n")).where(test)


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 18_000) -> DataFrame:
    """(id, part, text): parts from 1 of at most ``size`` characters; a short text is one part."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text_col) / size)).cast("int")
    part = F.explode(F.sequence(F.lit(1), n)).alias("part")
    cut = docs.select(F.col(id_col), F.col(text_col).alias("_t"), part)
    return cut.select(F.col(id_col), "part", F.substring(F.col("_t"), (F.col("part") - 1) * size + 1, F.lit(size)).alias("text"))


def reassemble(parts: DataFrame, id_col: str, separator: str = "\n\n") -> DataFrame:
    """(id, text, n_parts): parts in numeric order with the separator between."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("part").cast("int").alias("part"), "text")))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"), F.count("*").alias("n_parts"))


def join_wrapped(lines: Column) -> Column:
    """Lines with wrapped ones put together.

    A line goes on from the one before if that speaks of a goal and has not
    ended, or if it starts in lower case (or a digit) where the one before
    plainly stopped in mid-sentence.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(a: Column, raw: Column) -> Column:
        line, buf = trimmed(raw), a["buf"]
        starts = line.rlike(r"^[\"“”'\-–—(\[]") | line.rlike(r"(?i)^(?:and|to|for|that|which|it|this|these|those|in|on|by|of)\b")
        goal = F.lower(buf).contains("goal") & (~buf.rlike(r"[.!?]$") | (F.size(F.split(buf, r"\s+")) < 80) | starts)
        wrap = line.rlike("^[a-z0-9]") & buf.rlike("[a-z],?$") & (F.length(buf) < 200)
        soft = line.rlike("^[a-z]") & ~buf.rlike(r"[.!;:]$") & (F.length(buf) < 160)
        empty, flush = line == "", F.when(buf != "", F.concat(a["out"], F.array(buf))).otherwise(a["out"])
        joined = (buf != "") & (goal | wrap | soft)
        return F.struct(F.when(~empty & (joined | (buf == "")), a["out"]).otherwise(flush).alias("out"), F.when(empty, F.lit("")).when(joined, F.concat_ws(" ", buf, line)).otherwise(line).alias("buf"))

    return F.aggregate(lines, start, step, lambda a: F.when(a["buf"] != "", F.concat(a["out"], F.array(a["buf"]))).otherwise(a["out"]))


def sentences(text: Column) -> Column:
    """Sentences; one that starts in lower case or follows a dangling ``to`` or ``for`` stays with the one before."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")
    start = F.array().cast("array<string>")

    def step(a: Column, part: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), a), -1)
        stays = (F.size(a) > 0) & (part.rlike('^["a-z]') | last.rlike(r"(?i)(?:\bto|\bfor|in order to)$"))
        return F.when(stays, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat_ws(" ", last, part)))).otherwise(F.concat(a, F.array(part)))

    return F.aggregate(parts, start, step)


def clauses(line: Column) -> Column:
    """Parts between semicolons, if there are several."""
    parts = F.filter(F.transform(F.split(line, ";+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(line))


def completed(section: Column, raw: Column) -> Column:
    """Section lines and behind them the raw ones whose text is not among them, repeats included."""
    missing = F.array_except(raw, section)  # few: mostly headers
    return F.concat(section, F.filter(raw, lambda x: F.array_contains(missing, x)))


def complete_lines(section: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Section lines (key, pos, line) and behind them the raw ones whose text is not among them."""
    known = section.select(key, "line").distinct()
    extra = raw.join(known, [key, "line"], "left_anti")
    return section.select(key, "line", F.lit(0).alias("source"), "pos").unionByName(extra.select(key, "line", F.lit(1).alias("source"), "pos"))


def narrative_blocks(docs: DataFrame, id_col: str, text_col: str, *, goal_cap: int = 25, least: int = 4) -> DataFrame:
    """The rebuild sectioniser: goal lines and cost lines, and the lines of longer runs of amounts that these lack."""
    found = cue_sections(docs, id_col, text_col, goal_cap=goal_cap, uncategorized=False)
    lines = explode_lines(docs, id_col, text_col).withColumn("line", trimmed(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("pos")
    money = F.col("line").rlike(HAS_MONEY)
    run = lines.withColumn("_m", money).withColumn("_g", F.sum((~money).cast("int")).over(w)).where("_m")
    long = run.withColumn("_n", F.count("*").over(Window.partitionBy(id_col, "_g"))).where(F.col("_n") >= least)
    extra = long.join(found.where("section = 'BMPs'").select(id_col, "line").distinct(), [id_col, "line"], "left_anti")
    return found.select(id_col, "pos", "line", "section").unionByName(extra.select(id_col, "pos", "line", F.lit("BMPs").alias("section")))
