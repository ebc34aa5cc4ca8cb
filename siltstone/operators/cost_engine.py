"""Cost tables: a registry of declarative patterns over arrays of lines.

A document is one row with the array of its lines, so a table is found and
parsed where the document lies: no shuffle, no band join, no line table.  A
:class:`Pattern` says which lines can head a table, which lines the table may
reach, what ends it, and how a line becomes a row.  Everything compiles to
built-in array functions; documents without an amount are left out first.

``cost_tables`` yields one row per table with its rows nested; ``cost_rows``
flattens them.  Totals are doubles rounded to cents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import HAS_MONEY, amounts, any_of, bound, canonical_unit, matched, money, number, trimmed

ROW_FIELDS = (
    ("name", "string"), ("code", "string"), ("section", "string"), ("quantity", "double"), ("unit", "string"), ("unit_raw", "string"), ("unit_cost", "double"), ("total_cost", "double"),
    ("raw_size", "string"), ("raw_cost", "string"), ("landowner_match", "double"), ("producer", "double"), ("nrcs", "double"), ("other", "double"),
    ("unit_cost_min", "double"), ("unit_cost_max", "double"), ("total_cost_min", "double"), ("total_cost_max", "double"), ("extra", "double"), ("line_no", "int"),
)

Line = Callable[[Column], Column]


def row_struct(**fields: Column) -> Column:
    """A row with the given fields, the others null."""
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in ROW_FIELDS])


def cents(value: Column) -> Column:
    return F.round(value, 2)


def total_of(rows: Column, name: str) -> Column:
    return cents(F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.coalesce(r[name], F.lit(0.0))))


def matches(pattern: str) -> Line:
    return lambda line: line.rlike(pattern)


def first_index(lines: Column, test: Line) -> Column:
    """1-based position of the first line that passes, 0 if none does."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int")


def count_ahead(lines: Column, at: Column, start: int, n: int, test: Line) -> Column:
    """How many of the n lines from at + start on pass (at is 0-based)."""
    return F.size(F.filter(F.slice(lines, at + (1 + start), F.lit(n)), test))


def positions(lines: Column, test: Line) -> Column:
    """0-based places of the lines that pass, in order."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


@dataclass(frozen=True)
class Pattern:
    """One kind of table.

    ``heads(lines)`` gives the 0-based places of the lines that head one; a
    text in which ``gate`` finds nothing has none.  The body is the ``reach``
    lines from i + ``first`` on (before i, if ``backward``), up to the first
    line that passes ``stop``; where rows stand up to the end of these lines, the
    table goes on with the rows behind them.  ``row`` turns a body line into a row, or null;
    ``rows`` gets the body and its lines' rows.  ``reported`` gets the head,
    the body, the stop line and what follows it.  Where ``shared``, every line
    can head a table: rows and stops are found once per document, not per head.
    """

    id: str
    confidence: float
    heads: Callable[[Column], Column]
    reach: int
    row: Line
    gate: str = r"\$"
    first: int = 1
    shared: bool = False
    backward: bool = False
    whole_document: bool = False
    stop: Line | None = None
    rows: Callable[[Column, Column], Column] | None = None
    reported: Callable[[Column, Column, Column, Column], Column] | None = None
    match_reported: Callable[[Column, Column, Column, Column], Column] | None = None
    computed_zero_is_null: bool = False
    min_rows: int = 1
    stop_at_two_blanks: bool = False
    measures: tuple[str, ...] = field(default=())


# --- Fixed values: what heads, ends and makes up the lines of each kind of table. ---

AMOUNT = r"\$([0-9][0-9,]*(?:\.[0-9]{2})?)"
RANGE = AMOUNT + r"(?:\s*-\s*" + AMOUNT + r")?"
CODED = r"^(?:\*?)([A-Z]{1,2}[0-9]{1,3})\.[\s\-]+(.+?)\s+" + AMOUNT + r"(?:\s+\(.*?\))?\s*$"
CODED_HEAD = r"^(?:\*?)([A-Z]{1,2}[0-9]{1,3})\.[\s\-]+.*?\$[0-9][0-9,]*(?:\.[0-9]{2})?"
PLAN_ROW = r"^(?:\*?)([A-Z]{1,2}[0-9]{1,3}[A-Za-z\.]*)\s+(.+?)\s+" + AMOUNT + r"(?:\s+\*\d+)?\s*$"
RANGE_HEAD = r"^(.*?)\s+\$[0-9][0-9,]*(?:\.[0-9]{2})?(?:\s*-\s*\$[0-9][0-9,]*(?:\.[0-9]{2})?)?\s+[0-9][0-9,].*?\s+\$[0-9][0-9,]*(?:\.[0-9]{2})?"
PRACTICE_UNITS = "ac|acre|acres|ft|feet|mi|machines?|hrs?|hours?|units?|basins?|ea"
ACTIVITY_UNITS = "ac|acre|acres|ft|feet|mi|units?|ea"
FUNDING_HEAD = r"(?i)Practice\s+Producer\s+NRCS\s+(?:EPA-?MDEQ|EPA\s*MDEQ)\s+Total"
FUNDING_LONG_HEAD = r"(?i)Projected\s+Costs.*Practice.*Producer.*NRCS.*(?:EPA-?MDEQ|EPA\s*MDEQ).*Total"
FUNDING_ROW = r"^(.*?) \$ ?([0-9][0-9,]*(?:\.[0-9]{2})?|-) \$ ?([0-9][0-9,]*(?:\.[0-9]{2})?|-) \$ ?([0-9][0-9,]*(?:\.[0-9]{2})?|-) (?:\$ ?([0-9][0-9,]*(?:\.[0-9]{2})?))?$"
NRCS_ROW = r"(?i)^(.*?)\s+\$?([0-9][0-9,]*(?:\.[0-9]{2})?)\s+([0-9][0-9,]*)\s+(acres?|acre|ft|feet|sqft|structures|each|ea|ponds?|ac)\s+\$?([0-9][0-9,]*(?:\.[0-9]{2})?)\s*$"
BOOTHS_ROW = r"^([0-9]+)\s+(.*?)\s+(ac|ft|ea|each|cuyd|sqft|gal|no)\s+" + AMOUNT + r"\s+([0-9][0-9,]*(?:\.[0-9]+)?)\s+" + AMOUNT + r"\s*$"
PHASE_ROW = r"^(.*?)\s+([0-9][0-9,]*(?:\.[0-9]+)?)\s+(each|acres|ac|cy|ft)\s+" + AMOUNT + r"\s*$"
BELL_ROW = r"^(.*?)\s+([0-9][0-9,]*(?:\.[0-9]+)?)\s+(feet|acres|structures|each)\s+\$([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:/\s*\w+)?\s+" + AMOUNT + r"\s*$"
UNITS_ROW = r"^(.*?)\s+" + AMOUNT + r"\s+([0-9][0-9,]*)\s+" + AMOUNT + r"\s*$"
MATCH_ROW = r"(.*?)(\$[0-9][0-9,]*(?:\.[0-9]{2})?)(?:\s+\$([0-9][0-9,]*(?:\.[0-9]{2})?))?\s*$"
ITEM_MATCH_ROW = r"^(.*?)\s+(\$[0-9][0-9,]*(?:\.[0-9]{2})?)(?:\s+\$([0-9][0-9,]*(?:\.[0-9]{2})?))?\s*$"
ITEM_ROW = r"^(.*?)\s+" + AMOUNT + r"\s*$"
TAIL_ROW = r"^(.*?)(\$[0-9][0-9,]*(?:\.[0-9]{2})?)\s*$"
SIZE_START = r"(?i)([0-9][0-9,]*\s*(?:ft|feet|ac|acre|acres|each|ea|structures|ponds?)|[0-9][0-9,]*\s*@)"
PLAN_HEADING = r"(?i)^(I+\.)\s+"
SPAN_END = r"(?i)^(?:Goal|Objective|Section|Table\s+\d+)"
BLANK = r"^\s*$"


def single_amount(line: Column) -> Column:
    return (F.size(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(0))) == 1) & line.rlike("[A-Za-z]{3,}")


def dollar(line: Column) -> Column:
    return line.rlike(HAS_MONEY)


def blank(line: Column) -> Column:
    return line.rlike(BLANK)


def digits(amount: Column) -> Column:
    """The value of a whole amount such as $1,234.50."""
    return F.translate(amount, "$,", "").try_cast("double")


def _tail_item(strip: str, put: str = "") -> Line:
    def row(line: Column) -> Column:
        def named(g: Callable[[int], Column]) -> Column:
            return bound(F.regexp_replace(trimmed(g(1)), strip, put), lambda name: F.when(name != "", row_struct(name=name, total_cost=digits(g(2)), raw_cost=g(2))))

        return F.when(line.contains("$"), matched(line, TAIL_ROW, 2, named))

    return row


def _sparse_row(line: Column) -> Column:
    return F.when(single_amount(line), _tail_item(r"[:•\-]+\s*$")(line))


def _range_row(units: str) -> Line:
    pattern = r"(?i)^(.*?)\s+" + RANGE + r"\s+([0-9][0-9,]*(?:\s*(?:" + units + r"))?(?:\s*x\s*[0-9][0-9,]*\s*ft)?)\s+" + RANGE + r"\s*$"

    def row(line: Column) -> Column:
        def costed(g: Callable[[int], Column], v: Column, size: Column, unit: Column) -> Column:
            low, high, least, most = (v[n] for n in ("low", "high", "least", "most"))
            high, most = F.coalesce(high, low), F.coalesce(most, least)
            return row_struct(
                name=trimmed(g(1)), quantity=number(F.regexp_extract(size, "([0-9][0-9,]*)", 1)), unit=canonical_unit(unit), unit_raw=unit, unit_cost=(low + high) / 2, total_cost=(least + most) / 2,
                raw_size=size, unit_cost_min=low, unit_cost_max=high, total_cost_min=least, total_cost_max=most,
            )

        def found(g: Callable[[int], Column]) -> Column:
            values = F.struct(*[number(g(i)).alias(n) for i, n in ((2, "low"), (3, "high"), (5, "least"), (6, "most"))])
            unit = lambda size: F.nullif(F.regexp_extract(F.trim(F.regexp_replace(size, "^[0-9][0-9,]*", "")), r"^\S*", 0), F.lit(""))
            return bound(values, lambda v: bound(F.trim(g(4)), lambda size: bound(unit(size), lambda u: costed(g, v, size, u))))

        return F.when(line.contains("$"), matched(line, pattern, 6, found))

    return row


def _nrcs_row(line: Column) -> Column:
    def costed(g: Callable[[int], Column], v: Column) -> Column:
        cost, quantity, total = v["cost"], v["quantity"], v["total"]
        each = F.when((cost != 0) & (quantity != 0), cost).when((quantity != 0) & (total != 0), total / quantity)
        return row_struct(name=trimmed(g(1)), quantity=quantity, unit=canonical_unit(g(4)), unit_raw=g(4), unit_cost=each, total_cost=total, raw_size=F.concat_ws(" ", g(3), g(4)), raw_cost=F.concat(F.lit("$"), g(5)))

    return matched(line, NRCS_ROW, 5, lambda g: bound(F.struct(number(g(2)).alias("cost"), number(g(3)).alias("quantity"), number(g(5)).alias("total")), lambda v: costed(g, v)))


def _funded(name: Column, v: Column) -> Column:
    """A row of what producer, NRCS and others pay, from four values; a missing or zero total is their sum."""
    parts = [F.get(v, F.lit(i)) for i in range(3)]
    total = F.coalesce(F.nullif(F.get(v, F.lit(3)), F.lit(0.0)), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    return row_struct(name=name, total_cost=total, producer=parts[0], nrcs=parts[1], other=parts[2])


def _funding_row(line: Column) -> Column:
    tight = F.regexp_replace(line, r"\s{2,}", " ")
    found = matched(tight, FUNDING_ROW, 5, lambda g: bound(F.array(*[number(g(i)) for i in (2, 3, 4, 5)]), lambda v: _funded(trimmed(g(1)), v)))
    return F.when(line.contains("$"), found)


def _loose_funding_row(line: Column) -> Column:
    """At least three amounts or dashes behind dollar signs, whatever stands between them."""
    parts = F.regexp_extract_all(line, F.lit(r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?|-)"), F.lit(1))
    return bound(F.transform(parts, number), lambda v: F.when(F.size(v) >= 3, _funded(trimmed(F.regexp_extract(line, r"^([^$]*)", 1)), v)))


def _plan_row(line: Column) -> Column:
    def coded(g: Callable[[int], Column]) -> Column:
        return bound(F.regexp_replace(g(1), r"\.+$", ""), lambda code: row_struct(name=F.concat_ws(" ", code, F.trim(g(2))), code=code, total_cost=number(g(3)), raw_cost=F.concat(F.lit("$"), g(3))))

    return F.when(line.contains("$") & ~line.rlike("(?i)^Subtotal:") & ~line.rlike(PLAN_HEADING), matched(line, PLAN_ROW, 3, coded))


def _plan_rows(body: Column, rows: Column) -> Column:
    """Coded lines, each with the last Roman-numbered heading before it as its section."""
    headings = positions(body, matches(PLAN_HEADING))
    placed = lambda at: lambda r, i: F.when(r.isNotNull(), r.withField("section", F.trim(F.get(body, F.array_max(F.filter(at, lambda h: h < i))))))
    return bound(headings, lambda at: F.filter(F.transform(rows, placed(at)), lambda r: r.isNotNull()))


def _coded_row(line: Column) -> Column:
    named = lambda g: row_struct(name=F.concat_ws(" ", g(1), F.trim(g(2))), code=g(1), total_cost=number(g(3)), raw_cost=F.concat(F.lit("$"), g(3)))
    return F.when(line.contains("$"), matched(line, CODED, 3, named))


def _coded_rows(body: Column, rows: Column) -> Column:
    """Coded lines; short lines that go on from one are added to it; five rows and then another line end the block."""
    empty = F.struct(F.array().cast(f"array<{_row_type()}>").alias("rows"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        line, row = x["line"], x["row"]
        goes_on = (F.size(a["rows"]) > 0) & F.trim(line).rlike(r"(?i)^(?:\(|for\b|to\b|and\b)") & ~dollar(line)
        longer = lambda last: F.concat(F.slice(a["rows"], F.lit(1), F.size(a["rows"]) - 1), F.array(last.withField("name", F.concat_ws(" ", last["name"], F.trim(line)))))
        other = bound(goes_on, lambda on: F.when(on, F.struct(bound(F.element_at(a["rows"], -1), longer).alias("rows"), F.lit(False).alias("done"))).otherwise(F.struct(a["rows"].alias("rows"), (F.size(a["rows"]) >= 5).alias("done"))))
        return F.when(a["done"] | line.rlike("(?i)^Subtotal:"), a).when(row.isNotNull(), F.struct(F.concat(a["rows"], F.array(row)).alias("rows"), F.lit(False).alias("done"))).otherwise(other)

    return F.aggregate(F.zip_with(body, rows, lambda line, row: F.struct(line.alias("line"), row.alias("row"))), empty, step, lambda a: a["rows"])


def _paired_rows(body: Column, rows: Column) -> Column:
    """Lines from the first amount on; one without an amount is put before the next if that has one."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held"))

    def step(a: Column, x: Column) -> Column:
        line, paid, held = x["line"], x["paid"], a["held"]
        out = F.when(paid & held.isNotNull(), F.concat(a["out"], F.array(F.concat_ws(" ", held, F.trim(line))))).when(paid, F.concat(a["out"], F.array(line)))
        return F.struct(out.when(held.isNotNull(), F.concat(a["out"], F.array(held))).otherwise(a["out"]).alias("out"), F.when(~paid, line).alias("held"))

    def merged(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: x["paid"]), True).cast("int")
        return bound(start, lambda s: F.when(s > 0, F.aggregate(F.slice(lines, s, F.size(lines)), empty, step, lambda a: a["out"])).otherwise(F.array().cast("array<string>")))

    marked = F.transform(body, lambda x: F.struct(x.alias("line"), dollar(x).alias("paid")))
    return kept_rows(bound(marked, merged), _units_row)


def _units_row(line: Column) -> Column:
    costed = lambda g: row_struct(name=trimmed(g(1)), quantity=number(g(3)), unit_cost=number(g(2)), total_cost=number(g(4)), raw_size=F.concat(g(3), F.lit(" units")), raw_cost=F.concat(F.lit("$"), g(4)))
    return F.when(line.contains("$"), matched(line, UNITS_ROW, 4, costed))


def split_at(left: Column, pattern: str, use: Callable[[Column, Column], Column]) -> Column:
    """use(name, size): a text before and from the pattern's first place; all of it is the name where there is none."""
    name = lambda at: F.when(at > 0, F.trim(F.substring(left, F.lit(1), at - 1))).otherwise(left)
    size = lambda at: F.when(at > 0, F.trim(F.substring(left, at, F.length(left)))).otherwise(F.lit(""))
    return bound(F.regexp_instr(left, F.lit(pattern)), lambda at: use(name(at), size(at)))


def _sized_row(line: Column) -> Column:
    def sized(g: Callable[[int], Column]) -> Column:
        build = lambda left: split_at(left, SIZE_START, lambda name, size: row_struct(name=bound(name, lambda n: F.when(n != "", n).otherwise(left)), raw_size=size, total_cost=digits(g(2)), raw_cost=g(2)))
        return bound(F.regexp_replace(trimmed(g(1)), r"^[-•]+\s*", ""), build)

    return F.when(line.contains("$"), matched(line, r"^(.*?)\s+(\$[0-9][0-9,]*(?:\.[0-9]{2})?)\s*$", 2, sized))


def _item_match_row(line: Column) -> Column:
    taken = line.contains("$") & ~line.rlike(r"(?i)Total\s+Estimated\s+Project\s+Cost")
    return F.when(taken, matched(line, ITEM_MATCH_ROW, 3, lambda g: row_struct(name=trimmed(g(1)), total_cost=digits(g(2)), landowner_match=number(g(3)), raw_cost=g(2))))


def _match_row(line: Column) -> Column:
    def sized(g: Callable[[int], Column]) -> Column:
        def named(name: Column, size: Column) -> Column:
            plain = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^BMPs\s*", ""), r":+$", ""))
            return bound(plain, lambda n: F.when(n != "", row_struct(name=n, raw_size=size, total_cost=digits(g(2)), landowner_match=number(g(3)), raw_cost=g(2))))

        return bound(F.regexp_replace(trimmed(g(1)), r"^[-•]+\s*", ""), lambda left: split_at(left, r"(\b[0-9][0-9,]*\b.*@|\b[0-9][0-9,]*\b|N/A)", named))

    return F.when(line.contains("$") & ~line.rlike("(?i)Total Estimated Project Cost"), matched(line, MATCH_ROW, 3, sized))


def _booths_row(line: Column) -> Column:
    costed = lambda g: row_struct(
        name=F.concat_ws(" - ", g(1), F.trim(g(2))), code=g(1), unit=canonical_unit(g(3)), unit_raw=g(3), unit_cost=number(g(4)),
        quantity=number(g(5)), total_cost=number(g(6)), raw_size=F.concat_ws(" ", g(5), g(3)), raw_cost=F.concat(F.lit("$"), g(6)),
    )
    return F.when(line.contains("$"), matched(line, BOOTHS_ROW, 6, costed))


def _phase_row(line: Column) -> Column:
    def costed(g: Callable[[int], Column], v: Column, unit: Column) -> Column:
        each = F.when((v["quantity"] != 0) & (v["total"] != 0), v["total"] / v["quantity"])
        return row_struct(name=trimmed(g(1)), quantity=v["quantity"], unit=unit, unit_raw=unit, unit_cost=each, total_cost=v["total"], raw_size=F.concat_ws(" ", g(2), g(3)), raw_cost=F.concat(F.lit("$"), g(4)))

    found = lambda g: bound(F.struct(number(g(2)).alias("quantity"), number(g(4)).alias("total")), lambda v: costed(g, v, F.when(g(3) == "acres", "ac").otherwise(g(3))))
    return F.when(line.contains("$"), matched(line, PHASE_ROW, 4, found))


def _bell_row(line: Column) -> Column:
    def costed(g: Callable[[int], Column]) -> Column:
        unit = F.when(g(3) == "feet", "ft").when(g(3) == "acres", "ac").otherwise(g(3))
        return row_struct(name=trimmed(g(1)), quantity=number(g(2)), unit=unit, unit_raw=unit, unit_cost=money(g(4)), total_cost=number(g(5)), raw_size=F.concat_ws(" ", g(2), g(3)), raw_cost=F.concat(F.lit("$"), g(5)))

    return F.when(line.contains("$"), matched(line, BELL_ROW, 5, costed))


def _item_row(line: Column) -> Column:
    return F.when(line.contains("$"), matched(line, ITEM_ROW, 2, lambda g: row_struct(name=trimmed(g(1)), total_cost=number(g(2)), raw_size=F.lit("N/A"), raw_cost=F.concat(F.lit("$"), g(2)))))


def _adaptive_row(line: Column) -> Column:
    exact = r"^(.*?)\s+" + AMOUNT + r"(?:\s+" + AMOUNT + r")?\s*$"
    named = lambda g: row_struct(name=trimmed(g(1)), total_cost=number(g(2)), raw_cost=F.concat(F.lit("$"), g(2)), extra=number(g(3)))

    def loose(at: Column) -> Column:
        built = lambda name: bound(amounts(F.substring(line, at, F.length(line))), lambda v: F.when((name != "") & (F.size(v) > 0), row_struct(name=name, total_cost=F.get(v, F.lit(0)), extra=F.get(v, F.lit(1)))))
        return F.when(at > 6, bound(F.trim(F.substring(line, F.lit(1), at - 1)), built))

    return F.when(dollar(line), F.coalesce(matched(line, exact, 3, named), bound(F.regexp_instr(line, F.lit(HAS_MONEY)), loose)))


def _adaptive_rows(body: Column, rows: Column) -> Column:
    """Rows up to the first line without an amount that follows more than four rows."""
    def cut(unpaid: Column) -> Column:
        before = lambda i: F.size(F.filter(F.slice(rows, F.lit(1), i), lambda r: r.isNotNull()))
        first = F.get(F.filter(unpaid, lambda i: before(i) > 4), F.lit(0))
        return F.filter(F.slice(rows, F.lit(1), F.coalesce(first, F.size(rows))), lambda r: r.isNotNull())

    return bound(positions(body, lambda x: ~dollar(x)), cut)


def _row_type() -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in ROW_FIELDS) + ">"


def kept_rows(body: Column, row: Line) -> Column:
    return F.filter(F.transform(body, row), lambda r: r.isNotNull())


# What a table reports: functions of (head line, body, stop line, lines behind the stop).
def on_stop(pick: Callable[[Column], Column], pattern: str = ".") -> Callable[[Column, Column, Column, Column], Column]:
    return lambda head, body, stop, rest: F.when(stop.rlike(pattern), pick(stop))


def first_amount(line: Column) -> Column:
    return F.get(amounts(line), F.lit(0))


def behind_stop(head: Column, body: Column, stop: Column, rest: Column) -> Column:
    """The first amount behind a line that only says Total."""
    return F.when(stop.rlike(r"(?i)^Total\s*$"), first_amount(F.get(F.filter(rest, dollar), F.lit(0))))


def sum_subtotals(head: Column, body: Column, stop: Column, rest: Column) -> Column:
    subtotals = F.transform(F.filter(body, matches("(?i)^Subtotal:")), lambda x: F.coalesce(first_amount(x), F.lit(0.0)))
    return F.nullif(cents(F.aggregate(subtotals, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))


def head_amount(i: int) -> Callable[[Column, Column, Column, Column], Column]:
    return lambda head, body, stop, rest: F.get(amounts(head), F.lit(i))


def document_amount(i: int) -> Callable[[Column, Column, Column, Column], Column]:
    """Of the document's last line with the project's total."""
    return lambda head, body, stop, rest: F.get(amounts(F.element_at(F.concat(F.array(F.lit("")), F.filter(body, matches("(?i)Total Estimated Project Cost"))), -1)), F.lit(i))


Heads = Callable[[Column], Column]


def _said(*patterns: str, unless: str | None = None) -> Heads:
    """Lines that say one of the patterns."""
    said = lambda x: any_of([x.rlike(p) for p in patterns])
    return lambda lines: positions(lines, (lambda x: said(x) & ~x.rlike(unless)) if unless else said)


def _dense(test: Line, least: int, within: int, unless: str | None = None) -> Heads:
    """Lines that pass and have ``least`` others that pass among the ``within`` behind them."""
    def heads(hits: Column) -> Column:
        near = lambda i, k: (F.get(hits, k + least) - i) <= within
        return F.filter(hits, near)

    def unsaid(lines: Column) -> Column:
        found = bound(positions(lines, test), heads)
        return F.filter(found, lambda i: ~F.get(lines, i).rlike(unless)) if unless else found

    return unsaid


def _either(*heads: Heads) -> Heads:
    return lambda lines: F.array_union(heads[0](lines), heads[1](lines))


def _header(*parts: str) -> Heads:
    """Lines that say all of the parts."""
    def said(x: Column) -> Column:
        test = x.rlike(parts[0])
        for p in parts[1:]:
            test = test & x.rlike(p)
        return test

    return lambda lines: positions(lines, said)


def _near_lines(pattern: str, n: int, *parts: str) -> Heads:
    """Lines that say the pattern, where they and what follows within n lines say the parts."""
    def near(lines: Column) -> Column:
        said = lambda text: any_of([~text.rlike(p) for p in parts])
        return F.filter(positions(lines, matches(pattern)), lambda i: bound(F.array_join(F.slice(lines, i + 1, F.lit(n)), " "), lambda text: ~said(text)))

    return near


#: Where a head is sought at all: what every one of its lines has.
BOOTHS_HEAD = r"(?i)Code\s+Practice\s+Units\s+Cost.*Estimated.*Units.*Total"
BELL_HEAD = r"(?i)Practice\s+Area Affected\s+BMP Cost\s+BMP Total"
PHASE_HEAD = r"(?i)BMPs\s*Amount\s*Estimated Cost"
MATCH_HEAD = "(?i)Activity.*Size.*Estimated Cost.*Landowner Match"
NRCS_HEAD = r"(?i)Practice\s+Average\s+Unit\s+NRCS\s+Cost\s+Units\s+Total\s+Cost"
PLAN_HEAD = r"(?i)WATERSHED IMPLEMENTATION PLAN – BUDGET ESTIMATES|Watershed Implementation Plan\s*$"
ACTIVITY_HEAD = r"(?i)Activity\s+Size/?Amount\s+Estimated\s+Cost"
PRACTICE_LINE = r"(?i)^Practice\s*$"

PATTERNS: Sequence[Pattern] = (
    Pattern("sparse_inline_costs", 0.45, _dense(single_amount, 4, 69), 140, _sparse_row, first=0, shared=True, min_rows=5, stop_at_two_blanks=True),
    Pattern("narrative_cost_block", 0.55, _dense(dollar, 3, 3, r"(?i)Practice\s+Producer\s+NRCS|Activity\s+Size|Practice\s+Average\s+Unit"), 40, _tail_item(r"^([^\-•]*)[\-•]+\s*", "$1"), first=0, shared=True, stop=lambda x: blank(x) | ~dollar(x), min_rows=4),
    Pattern("coded_activity_budget_loose", 0.68, _dense(matches(CODED_HEAD), 2, 14), 160, _coded_row, first=0, shared=True, stop=lambda x: blank(x) | x.rlike(r"(?i)^(?:Goal|Objective|Section|Table)\b"), rows=_coded_rows, min_rows=5),
    Pattern(
        "practice_unit_cost_range", 0.78, _either(_header(r"(?i)Practice\s+Unit\s+Cost", r"(?i)Number\s+of\s+Units", r"(?i)Total\s+Cost"), _dense(matches(RANGE_HEAD), 2, 15)), 119, _range_row(PRACTICE_UNITS), shared=True,
        stop=lambda x: blank(x) | x.rlike(r"(?i)^\s*Total|Table\s+\d+|Goal|Objective"), reported=on_stop(lambda x: (F.array_min(amounts(x)) + F.array_max(amounts(x))) / 2, r"(?i)^\s*Total"), computed_zero_is_null=True,
    ),
    Pattern(
        "activity_unit_cost_range", 0.75, _either(_header(r"(?i)Activity\s+Unit\s+cost", r"(?i)Number\s+of\s+units", r"(?i)Total\s+cost"), _dense(matches(RANGE_HEAD), 2, 14)), 99, _range_row(ACTIVITY_UNITS), shared=True,
        stop=lambda x: blank(x) | x.rlike(r"(?i)TOTAL|Table\s+\d+|Goal|Objective"), reported=on_stop(lambda x: F.aggregate(amounts(x), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(amounts(x)), F.lit(0)), "(?i)TOTAL"), computed_zero_is_null=True,
    ),
    Pattern("practice_unit_nrcs_costs", 0.85, _said(NRCS_HEAD), 49, _nrcs_row, gate=NRCS_HEAD, stop=matches(r"(?i)^\s*TOTAL"), reported=on_stop(first_amount)),
    Pattern("multi_funding_source_costs", 0.83, _said(FUNDING_HEAD, FUNDING_LONG_HEAD), 39, _funding_row, gate=r"(?i)Practice", stop=matches("(?i)Totals"), reported=on_stop(lambda x: F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.transform(F.regexp_extract_all(x, F.lit(r"\$\s*([0-9][0-9,]*(?:\.[0-9]{2})?)"), F.lit(1)), number)), -1)), measures=("producer", "nrcs", "other")),
    Pattern("implementation_plan_coded_budget", 0.70, _said(PLAN_HEAD), 299, _plan_row, gate=PLAN_HEAD, stop=lambda x: x.rlike(r"(?i)^III\.|^Section\s+3|^VII\.") & ~x.rlike(PLAN_HEADING), rows=_plan_rows, reported=sum_subtotals),
    Pattern("generic_activity_costs", 0.80, _said(ACTIVITY_HEAD, unless=r"(?i)Landowner\s+Match"), 59, _sized_row, gate=ACTIVITY_HEAD, stop=matches(r"(?i)^Total\s+Estimated\s+Project\s+Cost|Element\s+[A-I]:|Technical Assistance|Education/Outreach"), reported=on_stop(first_amount, "(?i)^Total")),
    Pattern("total_estimated_project_cost_block", 0.75, _header(r"(?i)Total\s+Estimated\s+Project\s+Cost", "(?i)Match"), 34, _item_match_row, gate=r"(?i)Total\s+Estimated\s+Project\s+Cost", backward=True, stop=matches(r"(?i)Element\s+[A-I]:"), reported=head_amount(0), match_reported=head_amount(1), measures=("landowner_match",)),
    Pattern("booths_creek_bmps", 0.95, _said(BOOTHS_HEAD), 59, _booths_row, gate=BOOTHS_HEAD, stop=matches(r"(?i)^Total\s*\$[0-9]|In addition to these costs|Element\s+[A-I]:"), reported=on_stop(first_amount, "(?i)^Total"), computed_zero_is_null=True),
    Pattern("phase1_bmps", 0.90, _said(PHASE_HEAD), 39, _phase_row, gate=PHASE_HEAD, stop=matches(r"(?i)^Total.*\$[0-9]|Technical Assistance|Education and Outreach|Monitoring|Project Management"), reported=on_stop(first_amount, "(?i)^Total"), computed_zero_is_null=True),
    Pattern("activity_match", 0.85, _said(MATCH_HEAD), 0, _match_row, gate=MATCH_HEAD, whole_document=True, reported=document_amount(0), match_reported=document_amount(1), measures=("landowner_match",)),
    Pattern("practice_costs", 0.88, _near_lines(PRACTICE_LINE, 6, "(?i)Unit Cost", "(?i)Total Cost"), 80, lambda x: F.lit(None), gate=PRACTICE_LINE, first=0, stop=matches(r"(?i)^Total\s*$|Low DO/Organic|Participants"), rows=_paired_rows, reported=behind_stop),
    Pattern("bell_creek_bmps", 0.90, _said(BELL_HEAD), 49, _bell_row, gate=BELL_HEAD, stop=matches(r"(?i)^\s*Total\s*$|Technical Assistance|Table\s*8\.2"), reported=behind_stop),
    Pattern("tech_assistance", 0.85, _said(r"(?i)Item\s+Cost", unless="(?i)Technical Assistance"), 24, _item_row, gate=r"(?i)Item\s+Cost", stop=matches(r"(?i)^Total\s+\$[0-9]"), reported=on_stop(first_amount)),
    Pattern(
        "adaptive_generic_costs", 0.50, _dense(dollar, 2, 11, r"(?i)Practice\s+Average\s+Unit|Producer\s+NRCS|Code\s+Practice\s+Units|Activity\s+Size"), 80, _adaptive_row, first=0, shared=True,
        stop=lambda x: blank(x) | x.rlike(r"(?i)Goal|Objective|Section|Table\s+\d+|Implementation Plan"), rows=_adaptive_rows, min_rows=3,
    ),
)


def first_of(heads: Heads) -> Heads:
    return lambda lines: F.slice(heads(lines), F.lit(1), F.lit(1))


FUNDING_FALLBACK = replace(next(p for p in PATTERNS if p.id == "multi_funding_source_costs"), confidence=0.80, heads=first_of(_said(FUNDING_HEAD)), reach=29, row=_loose_funding_row)


def raw_lines(text: Column, keep_blank: bool = False) -> Column:
    """Trimmed lines of a text; blank ones only on request."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), trimmed)
    return lines if keep_blank else F.filter(lines, lambda x: x != "")


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_blank: bool = False) -> DataFrame:
    """(doc_id, lines): trimmed lines; blank ones only on request."""
    return docs.select(F.col(id_col).alias("doc_id"), raw_lines(F.col(text_col), keep_blank).alias("lines"))


def parsed(lines: Column, p: Pattern) -> Column:
    """array<struct<pattern_id, pattern_confidence, at, rows, total_computed, total_reported, match_reported>> of one pattern's tables in a document's lines; null where nothing heads one."""
    stop = p.stop
    if p.stop_at_two_blanks:
        stops = F.transform(lines, lambda x, i: (x == "") & (F.coalesce(F.get(lines, i + 1), F.lit("-")) == ""))
    else:
        stops = F.transform(lines, lambda x: F.coalesce(stop(x), F.lit(False))) if stop else F.transform(lines, lambda x: F.lit(False))

    def table(at: Column, body: Column, rows: Column, stop_line: Column, rest: Column) -> Column:
        """What a head, its body and rows make; null where there are too few."""
        def totalled(rows: Column) -> Column:
            computed = total_of(rows, "total_cost")
            if p.computed_zero_is_null:
                computed = F.nullif(computed, F.lit(0.0))
            if p.id == "coded_activity_budget_loose":
                # rows and subtotals both count towards what it reports
                reported = F.nullif(cents(computed + F.coalesce(sum_subtotals(at, body, stop_line, rest), F.lit(0.0))), F.lit(0.0))
            else:
                reported = p.reported(F.get(lines, at), body, stop_line, rest) if p.reported else F.lit(None)
            match = p.match_reported(F.get(lines, at), body, stop_line, rest) if p.match_reported else F.lit(None)
            fields = F.struct(F.lit(p.id).alias("pattern_id"), F.lit(p.confidence).alias("pattern_confidence"), at.alias("at"), rows.alias("rows"), computed.alias("total_computed"), cents(reported.cast("double")).alias("total_reported"), cents(match.cast("double")).alias("match_reported"))
            return F.when(F.size(rows) >= p.min_rows, fields)

        return bound(rows, totalled)

    kept = lambda body, rows: p.rows(body, rows) if p.rows else F.filter(rows, lambda r: r.isNotNull())
    none = F.array().cast("array<string>")

    def own(at: Column) -> Column:
        """A table whose window is looked at by itself."""
        if p.whole_document:
            window = lines
        elif p.backward:
            n = F.least(at, F.lit(p.reach))
            window = F.reverse(F.slice(lines, at - n + 1, n))
        else:
            window = F.slice(lines, at + 1 + p.first, F.lit(p.reach))

        def cut(w: Column, s: Column) -> Column:
            body = F.when(s > 0, F.slice(w, F.lit(1), s - 1)).otherwise(w)
            rest = F.when(s > 0, F.slice(w, s + 1, F.lit(p.reach + 1))).otherwise(none)
            return bound(F.reverse(body) if p.backward else body, lambda b: table(at, b, kept(b, F.transform(b, p.row)), F.when(s > 0, F.get(w, s - 1)), rest))

        look = lambda w: bound(first_index(w, stop) if stop else F.lit(0), lambda s: cut(w, s))
        if p.backward or p.whole_document or p.rows or not stop:
            return bound(window, look)

        def whole(w: Column) -> Column:
            """The window and, if its last line is a row and nothing in it ends the table, the rows that go on behind it with what ends them."""
            behind = F.slice(lines, at + 1 + p.first + p.reach, F.greatest(F.lit(0), F.size(lines) - at - p.first - p.reach))
            more = lambda b, k: F.when(k == 0, b).when(stop(F.get(b, k - 1)), F.slice(b, F.lit(1), k + 1)).otherwise(F.slice(b, F.lit(1), k - 1))
            longer = lambda b: bound(first_index(b, lambda x: stop(x) | p.row(x).isNull()), lambda k: F.concat(w, more(b, k)))
            cut_off = (F.size(w) == p.reach) & (F.size(lines) > at + p.first + p.reach)
            return F.when(cut_off & (first_index(w, stop) == 0) & p.row(F.get(w, F.lit(p.reach - 1))).isNotNull(), bound(behind, longer)).otherwise(w)

        return bound(window, lambda w: bound(whole(w), look))

    def common(at: Column, rows: Column, stops: Column) -> Column:
        """A table whose lines' rows and stops are known."""
        low = at + 1 + p.first

        def cut(s: Column) -> Column:
            n = F.when(s > 0, s - 1).otherwise(F.lit(p.reach))
            body = F.slice(lines, low, n)
            return table(at, body, bound(F.slice(rows, low, n), lambda r: kept(body, r)), F.when(s > 0, F.get(lines, low + s - 2)), none)

        return bound(F.array_position(F.slice(stops, low, F.lit(p.reach)), True).cast("int"), cut)

    def tables(heads: Column) -> Column:
        if p.shared:
            known = F.struct(F.transform(lines, p.row).alias("rows"), stops.alias("stops"))
            found = bound(known, lambda k: F.transform(heads, lambda at: common(at, k["rows"], k["stops"])))
        else:
            found = F.transform(heads, own)
        return F.when(F.size(heads) > 0, F.filter(found, lambda t: t.isNotNull()))

    return bound(p.heads(lines), tables)


def span_marks(lines: Column) -> tuple[Column, Column]:
    """Per line whether it ends a table's span, and whether it has an amount."""
    return F.transform(lines, lambda x: blank(x) | x.rlike(SPAN_END)), F.transform(lines, dollar)


def span_end(at: Column, ends: Column) -> Column:
    after = F.slice(ends, at + 2, F.lit(119))
    return bound(F.array_position(after, True).cast("int"), lambda end: F.when(end > 0, at + end).otherwise(at + 1 + F.size(after)))


def dollar_lines(at: Column, end: Column, paid: Column) -> Column:
    return F.filter(F.transform(F.slice(paid, at + 1, end - at), lambda x, i: F.when(x, i + at)), lambda i: i.isNotNull())


def measured(found: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """The columns of tables, from (doc_id, title, span_end, dollar_lines, t) with t as :func:`parsed` gives it."""
    def measure(name: str) -> Column:
        ids = [p.id for p in patterns if name in p.measures]
        return F.when(F.col("t.pattern_id").isin(ids), total_of(F.col("t.rows"), name)) if ids else F.lit(None).cast("double")

    t = found.select(
        "doc_id", "t.pattern_id", "t.pattern_confidence", "title", F.col("t.at").alias("span_start"), "span_end", "dollar_lines", "t.rows", "t.total_reported", "t.total_computed",
        "t.match_reported", measure("landowner_match").alias("match_computed"), *[measure(m).alias(f"{m}_computed") for m in ("producer", "nrcs", "other")],
    )
    return t.select(
        "doc_id", "pattern_id", "pattern_confidence", "title", "span_start", "span_end", "dollar_lines", "rows", "total_reported", "total_computed",
        cents(F.col("total_reported") - F.col("total_computed")).alias("discrepancy"), "match_reported", "match_computed", cents(F.col("match_reported") - F.col("match_computed")).alias("match_discrepancy"), "producer_computed", "nrcs_computed", "other_computed",
    )


def tables_of(lined: DataFrame, pattern: Pattern) -> DataFrame:
    """Every table of one pattern: each line that can head one is tried."""
    ends, paid = span_marks(F.col("lines"))
    found = lined.select("doc_id", "lines", ends.alias("_ends"), paid.alias("_paid"), F.explode(parsed(F.col("lines"), pattern)).alias("t"))
    found = found.select("doc_id", F.trim(F.get("lines", F.col("t.at"))).alias("title"), span_end(F.col("t.at"), F.col("_ends")).alias("span_end"), "_paid", "t")
    return measured(found.withColumn("dollar_lines", dollar_lines(F.col("t.at"), F.col("span_end"), F.col("_paid"))), [pattern])


def gated(lines: Column, text: Column, p: Pattern) -> Column:
    """:func:`parsed`, where the text of the lines has what every head of the pattern has."""
    return F.when(text.rlike("(?m)" + p.gate), parsed(lines, p))


def all_of(parts: Sequence[Column]) -> Column:
    """One array of several, null ones left out."""
    return F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def spanned(lines: Column, tables: Column) -> Column:
    """Tables as :func:`parsed` gives them, each as a struct of itself, ``title``, ``span_end`` and ``dollar_lines``."""
    ends, paid = span_marks(lines)

    def put(m: Column) -> Column:
        one = lambda t, end: F.struct(t.alias("t"), F.trim(F.get(lines, t["at"])).alias("title"), end.alias("span_end"), dollar_lines(t["at"], end, m["paid"]).alias("dollar_lines"))
        return F.transform(tables, lambda t: bound(span_end(t["at"], m["ends"]), lambda end: one(t, end)))

    return F.when(F.size(tables) > 0, bound(F.struct(ends.alias("ends"), paid.alias("paid")), put))


def registry_tables(lines: Column, patterns: Sequence[Pattern], keep_covered: bool = False) -> Column:
    """array<struct<t, title, span_end, dollar_lines>>: the tables of every pattern in a document's lines, in one look at the document."""
    def every(text: Column) -> Column:
        parts = []
        for p in patterns:
            found = gated(lines, text, p)
            if p.id == FUNDING_FALLBACK.id:
                found = bound(found, lambda own: F.when(F.size(own) > 0, own).otherwise(gated(lines, text, FUNDING_FALLBACK)))
            parts.append(found)
        return all_of(parts)

    def uncovered(tables: Column) -> Column:
        adaptive = lambda t: t["t"]["pattern_id"] == "adaptive_generic_costs"
        explicit = F.filter(tables, lambda t: ~adaptive(t))
        return bound(explicit, lambda s: F.filter(tables, lambda t: ~adaptive(t) | ~F.exists(s, lambda e: covers(e["t"]["at"], e["span_end"], e["dollar_lines"], t["t"]["at"], t["span_end"], t["dollar_lines"]))))

    text = F.when(F.exists(lines, lambda x: x.contains("$")), F.array_join(lines, "\n"))
    found = bound(text, lambda x: F.when(x.isNotNull(), bound(every(x), lambda tables: spanned(lines, tables))))
    return found if keep_covered else bound(found, uncovered)


def covers(s: Column, e: Column, own: Column, start: Column, end: Column, lines: Column) -> Column:
    """Whether a table's span or amounts (s, e, own) have those of another."""
    return ((s <= start) & (e >= end)) | ((F.size(lines) > 0) & (F.size(F.array_except(lines, own)) == 0))


def cost_tables(lined: DataFrame, patterns: Sequence[Pattern] = PATTERNS, *, keep_covered: bool = False, apart: bool = False) -> DataFrame:
    """All tables of (doc_id, lines): every pattern on every line, adaptive ones that others cover left out.

    ``apart`` keeps those that :func:`non_overlapping` keeps.  ``lined`` is read
    once; all of a document's tables are found and compared in its row.
    """
    found = registry_tables(F.col("lines"), patterns, keep_covered)
    if apart:
        key = lambda x: F.struct((-x["t"]["pattern_confidence"]).alias("o"), x["t"]["at"].alias("s"), x["t"]["pattern_id"].alias("p"), x["span_end"].alias("e"))
        found = bound(found, lambda tables: bound(disjoint(F.transform(tables, key)), lambda keys: F.filter(tables, lambda x: F.array_contains(keys, key(x)))))
    flat = lined.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.title", "x.span_end", "x.dollar_lines", "x.t")
    return measured(flat, patterns)


def disjoint(keys: Column) -> Column:
    """Of keys of tables, with start s and end e, in their order those that overlap none kept before."""
    fold = lambda ordered: F.aggregate(ordered, F.slice(ordered, F.lit(1), F.lit(0)), lambda a, t: F.when(F.exists(a, lambda k: (k["s"] < t["e"]) & (t["s"] < k["e"])), a).otherwise(F.concat(a, F.array(t))))
    return bound(F.array_sort(keys), fold)


def drop_covered(tables: DataFrame) -> DataFrame:
    """Adaptive blocks go whose span, or whose amounts, an explicit table of the document has.

    One group per document that has an adaptive block; the others pass as they are.
    """
    adaptive = F.col("pattern_id") == "adaptive_generic_costs"
    own = [c for c in tables.columns if c != "doc_id"]
    explicit = F.collect_list(F.when(~adaptive, F.struct("span_start", "span_end", "dollar_lines")))
    grouped = tables.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_t"), explicit.alias("_s"))

    def covered(t: Column) -> Column:
        inside = lambda s: (s["span_start"] <= t["span_start"]) & (s["span_end"] >= t["span_end"])
        same = lambda s: (F.size(t["dollar_lines"]) > 0) & (F.size(F.array_except(t["dollar_lines"], s["dollar_lines"])) == 0)
        return F.exists("_s", lambda s: inside(s) | same(s))

    kept = F.filter("_t", lambda t: (t["pattern_id"] != "adaptive_generic_costs") | ~covered(t))
    return grouped.select("doc_id", F.explode(kept).alias("t")).select("doc_id", "t.*")


def non_overlapping(tables: DataFrame) -> DataFrame:
    """The tables kept when each line counts once: by confidence, then position; one fold per document."""
    own = [c for c in tables.columns if c not in ("doc_id", "span_start", "pattern_id")]
    # numbers and strings first, so that the sort never compares nested columns
    row = F.struct((-F.col("pattern_confidence")).alias("o"), "span_start", "pattern_id", F.monotonically_increasing_id().alias("n"), F.struct(*own).alias("rest"))
    grouped = tables.select("doc_id", row.alias("t")).groupBy("doc_id").agg(F.collect_list("t").alias("_t"))
    keys = F.array_sort(F.transform("_t", lambda t: F.struct(t["o"].alias("o"), t["span_start"].alias("s"), t["pattern_id"].alias("p"), t["n"].alias("n"), t["rest"]["span_end"].alias("e"))))
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema}
    empty = F.array().cast(f"array<struct<o:double,s:{kinds['span_start']},p:string,n:bigint,e:{kinds['span_end']}>>")
    kept = F.aggregate(keys, empty, lambda a, t: F.when(F.exists(a, lambda k: (k["s"] < t["e"]) & (t["s"] < k["e"])), a).otherwise(F.concat(a, F.array(t))))
    numbers = F.transform(kept, lambda k: k["n"])
    mine = grouped.withColumn("_n", numbers).select("doc_id", F.explode(F.filter("_t", lambda t: F.array_contains(F.col("_n"), t["n"]))).alias("t"))
    return mine.select("doc_id", "t.span_start", "t.pattern_id", "t.rest.*").select(*tables.columns)


def cost_rows(tables: DataFrame) -> DataFrame:
    """One row per table row, with funding shares."""
    flat = tables.select("doc_id", "pattern_id", "span_start", F.posexplode("rows").alias("row_pos", "r")).select("doc_id", "pattern_id", "span_start", "row_pos", "r.*")
    share = lambda c: F.when(F.col("total_cost") != 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col("total_cost"))
    return flat.withColumn("pct_producer", share("producer")).withColumn("pct_nrcs", share("nrcs")).withColumn("pct_other", share("other"))


def merge_coded_budgets(tables: DataFrame) -> DataFrame:
    """Several coded implementation budgets of a document become one; equal codes in a section add up."""
    plan = tables.where(F.col("pattern_id") == "implementation_plan_coded_budget")
    several = plan.groupBy("doc_id").agg(F.count("*").alias("n"), cents(F.sum("total_reported")).alias("total_reported"), cents(F.sum("total_computed")).alias("total_computed")).where("n > 1")
    rows = plan.select("doc_id", "span_start", F.posexplode("rows").alias("p", "r")).join(several.select("doc_id"), "doc_id", "left_semi")
    first = F.min_by("r", F.struct("span_start", "p"))
    rows = rows.groupBy("doc_id", F.col("r.code").alias("code"), F.col("r.section").alias("section")).agg(first.alias("r"), cents(F.sum("r.total_cost")).alias("total"), F.min(F.struct("span_start", "p")).alias("o"))
    nested = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("r").withField("total_cost", F.col("total")).alias("r")))), lambda x: x["r"]).alias("rows"))
    merged = nested.join(several, "doc_id")
    # tables of other kinds pass by the join
    kept = tables.where(~F.col("pattern_id").eqNullSafe("implementation_plan_coded_budget")).unionByName(plan.join(several.select("doc_id"), "doc_id", "left_anti"))
    added = merged.select("doc_id", F.lit("implementation_plan_coded_budget").alias("pattern_id"), F.lit(0.72).alias("pattern_confidence"), F.lit("Implementation Plan Budget (Merged)").alias("title"), "rows", "total_reported", "total_computed", cents(F.col("total_reported") - F.col("total_computed")).alias("discrepancy"))
    return kept.unionByName(added, allowMissingColumns=True)
