"""Scalar functions over text: matching, numbers, units, names and slugs.

Each takes and returns Columns, so Catalyst can fold, prune and generate code
for them.  Patterns are literal, so Spark compiles each once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of units and their canonical forms.
UNITS: dict[str, str] = {
    "each": "each", "ea": "each", "no": "each", "ac": "acre", "acre": "acre", "acres": "acre", "ft": "ft", "feet": "ft",
    "cuyd": "cu_yd", "cy": "cu_yd", "sqft": "sq_ft", "gal": "gal",
}
LEGACY_UNITS: dict[str, str] = UNITS | {"lf": "linear_ft", "sf": "sq_ft", "yd": "yd", "yds": "yd", "gallons": "gal", "structures": "structures", "mgd": "mgd", "mg/l": "mg/l", "tpy": "tpy"}

MONEY = r"\$([0-9][0-9,]*(?:\.[0-9]{2})?)"
HAS_MONEY = r"\$[0-9]"


#: Parts the groups of a match: a noncharacter, which no text has.
MARK = "\uffff"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once however often it is used: a one-element transform."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matched(text: Column, pattern: str, groups: int, use: Callable[[Callable[[int], Column]], Column]) -> Column:
    """use(g) where the pattern matches, else null; g(i) is group i of the match, empty where it took no part.

    One look at the text for all groups.  The pattern must end at the end of the text, so that it matches once.
    """
    parts = F.split(F.regexp_replace(text, pattern, MARK + MARK.join(f"${i + 1}" for i in range(groups)) + MARK), MARK)
    return bound(parts, lambda p: F.when(F.size(p) == groups + 2, use(lambda i: F.get(p, F.lit(i)))))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: What counts as blank at the ends of a text: ASCII white space, the Unicode blanks, and the byte order mark.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without blanks at either end, the no-break kinds included."""
    return F.trim(text, F.lit(BLANKS))


def plain_spaces(text: Column) -> Column:
    """Every Unicode blank as a plain space; line breaks stay."""
    return F.regexp_replace(text, "[   -   　﻿]", " ")


def number(text: Column) -> Column:
    """Digits with thousands separators as a double; null where there is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def money(text: Column) -> Column:
    """The first amount, with or without a dollar sign; two decimals or none."""
    return number(F.regexp_extract(text, r"\$?([0-9][0-9,]*(?:\.[0-9]{2})?)", 1))


def amounts(text: Column) -> Column:
    """All dollar amounts of a line, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(1)), number)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a small constant table; null where the key has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def canonical_unit(unit: Column, table: dict[str, str] = UNITS) -> Column:
    """The unit's canonical name, else itself in lower case without odd characters."""
    return F.coalesce(lookup(unit, table), bound(F.regexp_replace(F.lower(unit), r"\.$", ""), lambda raw: F.coalesce(lookup(raw, table), F.regexp_replace(raw, "[^a-z0-9_]", ""))))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The value of the first pattern that matches; rules are tried in order."""
    column = F.lit(default)
    for pattern, value in reversed(rules):
        column = F.when(text.rlike(pattern), F.lit(value)).otherwise(column)
    return column


def last_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    """The value of the last pattern that matches."""
    return first_rule(text, list(reversed(rules)), default)


def slug(name: Column, most: int = 80) -> Column:
    """Lower case, hyphens between runs of letters and digits, at most ``most`` characters."""
    base = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(base, 1, most), F.lit("")), F.lit("document"))


def file_slug(name: Column) -> Column:
    """The batch form: without .pdf, blanks and underscores to hyphens, no length cap."""
    base = F.regexp_replace(F.lower(name), r"\.pdf$", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[_\s]+", "-"), "[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(base, "-+", "-"), "^-+|-+$", "")


def family(doc_id: Column) -> Column:
    """A document's family: its id without a trailing year and part."""
    return F.regexp_replace(doc_id, r"-(?:19|20)\d{2}(?:-(?:part)?\d+)?$", "")


#: Mis-decoded and typographic quotes and dashes, longest first, so that none hides another.
QUOTES: Sequence[tuple[str, str]] = (
    ("â€™|ΓÇÖ|[‘’]", "'"),
    ("â€“|â€”|ΓÇô|[–—]", "-"),
    ("â€œ|â€\u009d|â€|ΓÇ£|ΓÇ¥|[“”]", '"'),
)


def plain_quotes(text: Column) -> Column:
    """Plain quotes and dashes, single spaces."""
    for pattern, value in QUOTES:
        text = F.regexp_replace(text, pattern, value)
    return F.regexp_replace(text, r"\s+", " ")


def dehyphenated(text: Column) -> Column:
    """Words that a line break split, put together."""
    return F.regexp_replace(text, r"([A-Za-z])-(\s+)([a-z])", "$1$3")


def short_title(text: Column, characters: int = 140, words: int = 14) -> Column:
    """The text itself if short, else its first words and an ellipsis."""
    cut = F.concat(F.array_join(F.slice(F.split(text, r"\s+"), 1, words), " "), F.lit("…"))
    return F.when(F.length(text) <= characters, text).otherwise(cut)


def compact_money(value: Column) -> Column:
    """$1.2M, $3.4K or a whole number of dollars."""
    return (
        F.when(value >= 1e6, F.format_string("$%.1fM", value / 1e6))
        .when(value >= 1e3, F.format_string("$%.1fK", value / 1e3))
        .otherwise(F.concat(F.lit("$"), F.round(value, 0).cast("long").cast("string")))
    )


def canonical_name(name: Column) -> Column:
    """The form in which practice names are compared: case, blanks, end marks, feet and a plural s aside."""
    base = F.regexp_replace(trimmed(F.lower(name)), r"\s+", " ")
    base = F.regexp_replace(F.regexp_replace(base, r"[,:;]+$", ""), r"\(feet\)", "(ft)")
    return F.when(base.rlike("[^s]s$") & (F.length(base) > 3), F.regexp_replace(base, "s$", "")).otherwise(base)


def comparable(text: Column) -> Column:
    """The form in which extracted and gold texts are compared."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9%]+", " "))


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def cost_tail_cut(name: Column) -> Column:
    """A name without the quantities and prices behind it, if two characters or more are left."""
    cut = name
    for pattern in (r"\s+[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:ac|acres?|ft|feet|ea|es|lf|yds?|cy|cuyd|sq\.?ft)\b.*$", r"\s*@\s*\$.*$", r"\s+\$[0-9].*$"):
        cut = F.regexp_replace(cut, "(?i)" + pattern, "")
    cut = F.regexp_replace(F.trim(cut), r"[,:;\s]+$", "")
    return F.when(F.length(cut) >= 2, cut).otherwise(name)


def size_parts(size: Column) -> Column:
    """quantity, unit and unit_cost of a size such as ``10,000 ft @ $2.50/ft``."""
    before, after = lambda p: F.get(p, F.lit(0)), lambda p: F.get(p, F.lit(1))
    return bound(F.split(size, "@"), lambda p: F.struct(
        number(F.regexp_extract(before(p), r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)).alias("quantity"),
        canonical_unit(extract(before(p), r"[0-9][0-9,]*(?:\.[0-9]+)?\s*([A-Za-z_/]+)"), LEGACY_UNITS).alias("unit"),
        number(F.regexp_extract(after(p), r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1)).alias("unit_cost"),
    ))


def audience(line: Column) -> Column:
    return first_rule(line, [("(?i)public|community", "Community"), ("(?i)school|student", "Education")], "General")


def search_hit(haystack: Column, query: str) -> Column:
    """Every white-space token of the query is in the text, case aside."""
    low = F.lower(haystack)
    return reduce(lambda a, b: a & b, [low.contains(t) for t in query.lower().split()] or [F.lit(True)])


#: Phrases with which a goal starts.
GOAL_STARTS = r"(?i)(ultimate goal|overall goal|primary objective|primary goal|main goal|the goal is|our goal is|the objective is|our objective is|mission is to)"


def from_starter(description: Column, within: int = 160) -> Column:
    """A description cut to its first starting phrase, if none stands in its first characters; a leading ``as`` goes."""
    at = F.regexp_instr(description, F.lit(GOAL_STARTS))
    cut = F.when((at > within), F.substring(description, at, F.length(description))).otherwise(description)
    return F.regexp_replace(cut, r"(?i)^as[,\s]+", "")


def descriptor(text: Column) -> Column:
    """measure, unit, rate, quantity and parse confidence of a row's descriptor, by three tiers of strictness."""
    high = r"(?i)^([0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z_]+)\s*@\s*\$([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*/\s*[A-Za-z]+)?$"
    medium = r"(?i)^([0-9][0-9,]*(?:\.[0-9]+)?)\s*([A-Za-z_]+)\b"
    low = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    tier = F.when(text.rlike(high), "high").when(text.rlike(medium), "medium").when(text.rlike(low), "low").otherwise("none")
    return F.struct(
        F.coalesce(number(extract(text, high, 1)), number(extract(text, medium, 1)), number(extract(text, low, 1))).alias("quantity"),
        F.coalesce(extract(text, high, 2), extract(text, medium, 2)).alias("unit"), number(extract(text, high, 3)).alias("rate"), tier.alias("confidence"),
        F.array_compact(F.array(F.when(tier != "high", F.lit("no-rate")), F.when(tier.isin("low", "none"), F.lit("no-unit")), F.when(tier == "none", F.lit("no-quantity")))).alias("issues"),
    )


def cost_field(row: Column, priority: Sequence[str] = ("Total Cost", "Estimated Cost", "BMP Total", "Total", "Cost", "Amount")) -> Column:
    """The amount of a row given as map<string, string>: the first priority key that is there, else any cost-like key."""
    costly = F.map_filter(row, lambda k, v: k.rlike(r"(?i)cost|total|amount|price|budget") & v.rlike("[0-9]"))
    return F.coalesce(*[money(costly[p]) for p in priority], money(F.get(F.map_values(costly), F.lit(0))))


def metric(text: Column) -> Column:
    """value, unit and label of a metric's text: first number, first known unit, the rest normalised."""
    units = r"(?i)(mg/l|acres?|feet|ft|tons?|lbs|pounds|percent|%)"
    rest = F.regexp_replace(F.regexp_replace(text, r"[0-9][0-9,]*(?:\.[0-9]+)?", " "), units, " ")
    return F.struct(number(extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)")).alias("value"), F.lower(extract(text, units)).alias("unit"), comparable(rest).alias("label"))
