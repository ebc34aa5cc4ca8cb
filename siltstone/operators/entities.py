"""Goals, practices and activities from lines of planning documents.

Candidates are made first and their attributes extracted once, in one
projection, so that Spark evaluates each pattern once per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_name, cost_tail_cut, extract, first_rule, last_rule, number, plain_quotes, short_title, token_count
from siltstone.operators import lines as ln

# --- Fixed values: terms, patterns and categories that decide what is extracted. ---

POLLUTANTS = (
    r"(?i)(nitrogen|phosphorus|phosphate|nitrate|nitrite|ammonia|ammonium|sediment|tss|turbidity|bacteria|e\.?\s?coli|fecal coliform|coliform|ph|dissolved oxygen|temperature|metals?|zinc|copper|lead|mercury|chlorophyll|algae)"
)
AMOUNT = r"(\d{1,4}(?:,[0-9]{3})?(?:\.[0-9]+)?)"
MEASURE = r"(mg/L|mg\\L|ppm|%|tons?|lbs|pounds|acres?|kg)"
PERCENT_VERB = r"(?i)(reduce|decrease|lower|cut)\s+(.*?)(?:by\s+)?(\d{1,3}(?:\.\d+)?)\s?(%|percent\b)"
PERCENT_INLINE = r"(?i)(\d{1,3}(?:\.\d+)?)\s?(%|percent)\s+(reduction|decrease)"
BASELINE_TARGET = rf"(?i){AMOUNT}\s?{MEASURE}\s+(?:to|->|➡|versus|vs)\s+{AMOUNT}\s?{MEASURE}"
LOAD = rf"(?i)(reduce|remove|eliminate)\s+{AMOUNT}\s?(lbs|pounds|tons?|kg)"
QUANTITY = rf"(?i){AMOUNT}\s?(acres?|ft|feet|feet of|linear feet|lbs|pounds|tons?|kg|mg/L|mg\\L|ppm|%)"
DEADLINE = r"(?i)by\s+(20\d{2})"
YEAR = r"(20\d{2})"
RESPONSIBLE = r"(?i)(responsible|lead|agency|partner|coordinator|managed by)[:\-]\s*([^;,.]+)"
ACHIEVED = rf"(?i)(current|achieved|existing)[:\s]+{AMOUNT}(?:\s?(mg/L|mg\\L|ppm|%|tons?|lbs|pounds|kg))?"
COST = r"(?i)\$\s?([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\b|[0-9]+k\b)"
VERB = r"(?i)\b(install|construct|monitor|sample|educate|conduct|train|survey|upgrade|implement|maintain|restore|stabilize|plant|fence|exclude|retrofit)\b"
FREQUENCY = r"(?i)(annually|quarterly|monthly|weekly|daily|each\s+(?:spring|summer|fall|winter)|every\s+year)"
PRIMARY = r"(?i)(ultimate goal|overall goal|primary objective|primary goal|main goal|overarching goal|key goals?|principal goal|mission is to|vision is to|the goal is to|the objective is to)"
ADMITTED = r"(?i)(ultimate goal|overall goal|primary objective|primary goal|main goal|overarching goal|mission is to|vision is to|the goal is to|the objective is to|our goal is to|our objective is to)"
QUANTITATIVE = r"(?i)(reduce|decrease|lower|achieve|attain|improve)\s+(?:[a-z\s]+)?(\d{1,3}(?:\.\d+)?\s?(%|percent|mg/L|mg\\L|ppm|tons?|lbs|pounds|kg))"

BMP_CATEGORIES: Sequence[tuple[str, str]] = (
    (r"(?i)(riparian|stream) buffer|riparian corridor", "Vegetative Buffer"),
    (r"(?i)cover crop", "Vegetative"),
    (r"(?i)grassed waterway", "Erosion Control"),
    (r"(?i)nutrient management", "Nutrient Management"),
    (r"(?i)conservation tillage|no[- ]till", "Tillage"),
    (r"(?i)livestock exclusion|fencing", "Livestock Exclusion"),
    (r"(?i)streambank stabilization|bank stabilization", "Erosion Control"),
    (r"(?i)wetland restoration|constructed wetland", "Wetland"),
    (r"(?i)sediment basin|detention basin|retention basin", "Structural"),
    (r"(?i)rain garden|bioswale|infiltration (?:trench|basin)", "Infiltration"),
    (r"(?i)filter strip", "Filter Strip"),
    (r"(?i)stormwater pond", "Stormwater"),
    (r"(?i)culvert", "Hydrologic"),
    (r"(?i)drainage improvement|drainage system", "Hydrologic"),
)
REFINED_CATEGORIES: Sequence[tuple[str, str]] = (
    (r"(?i)cover\s+crops?", "Cover Crops"),
    (r"(?i)grassed\s+waterway", "Erosion Control"),
    (r"(?i)sediment basin|sedimentation basin|grade stabilization|terraces?|diversions?", "Structural Erosion"),
    (r"(?i)pond\b|stormwater pond|detention|retention", "Stormwater"),
    (r"(?i)streambank|shoreline|bank stabilization|riprap|revetment", "Streambank Stabilization"),
    (r"(?i)heavy use area protection|livestock|tank/trough|trough|watering facility", "Livestock Management"),
    (r"(?i)fencing", "Fencing"),
    (r"(?i)forage.*biomass planting|biomass planting|forage planting", "Forage & Biomass"),
    (r"(?i)aquatic|fisheries? management|fish habitat", "Aquatic Habitat"),
    (r"(?i)invasive|noxious", "Invasive Species"),
    (r"(?i)ag\s*bmp|agric|agriculture", "Agriculture"),
)
SUMMARY_CATEGORIES: Sequence[tuple[str, str]] = ((r"(?i)aquatic|fisher", "Aquatic"), (r"(?i)ag\s*bmp|agric|crop", "Agriculture"), (r"(?i)noxious|invasive", "Invasive Species"))
SUMMARY_LINE = r"^([A-Z][A-Za-z &/]+?)\s+\$[0-9,]{3,}(?:\.[0-9]{2})?$"

ACTION = r"(?i)(install|construct|stabilize|restore|plant|exclude|fence|retrofit|diversion|sediment|basin|buffer|pond|weir|seeding|tillage|cover crop|nutrient management|wetland|bioswale|rain garden|grassed waterway|filter strip|critical area planting|manager|implementation|monitor)"
VERBISH = r"(?i)(install|construct|stabilize|plant|exclude|fence|retrofit|implement|upgrade|repair|replace)"
STARTS_BAD = r"(?i)^(total( estimated)? cost|budget|the budget|september|october|november|december|january|february|march|april|may|june|july|august|q[1-4]\b|\d{1,2}/\d{1,2}/\d{2,4})"
COST_ONLY = r"(?i)^(total|amount|estimated cost|cost estimate|total estimated cost)$"
COST_WORD = r"(?i)\b(cost|budget|amount|estimated|dollars?)\b"
SCHEDULE = r"(?i)months? \d+\s*-\s*\d+$"
PHASE = r"(?i)\b(phase|year)\s*\d{1,2}\b"
TIME_RANGE = r"\b(20\d{2}\s*-\s*20\d{2})\b"
PERCENT = r"\b\d{1,3}%\b"
RETAINED = r"(?i)\b(fencing|structure|stabilization|planting|weir|basin|buffer|wetland|diversion|waterway|seeding)\b"

TITLE_NOISE = (
    r"(?i)^(project\s+goals?\s+goals?/objectives\s+\d+\s+)",
    r"(?i)^(project\s+goals?\s+objectives?\s+\d+\s+)",
    r"(?i)^(goals?\s+and\s+objectives?\s+)",
    r"(?i)^(goals?\s*[:;]\s*)",
    r"(?i)Goal Who What Where When Contacts",
    r"(?i)Goals?/Objectives?",
    r"(?i)^(?:Project\s+)?Goals?\b",
    r"(?i)^(the watershed implementation plan has the goals? of reducing the nutrients? and\s+)",
)
HEADING_WORDS, IMPROVES = "(?i)goals?", "(?i)(reduce|decrease|improve|achieve|attain|protect|restore)"
IMPROVES_POLLUTANT = "(?i)(reduce|decrease|improve|achieve|attain)"
GOAL_WORD, GOAL_HEADING = r"(?i)\bgoals?\b", r"(?i)^goals?:?$"
ULTIMATE = "the ultimate goal is to bring about"
ULTIMATE_LINE = "(?i)The ultimate goal is to bring about"
BROKEN_LINE = r"(?i)use of$"
BROKEN_TEXT = r"(?i)use of\s*(?:\n|$)"
WHOLE_TEXT = r"(?i)quality of life in the\s+watershed\."
KNOWN_PLAN = "(?i)dry creek watershed plan"
KNOWN_START = "(?i)The ultimate goal is to bring about behavior changes and the use of"
KNOWN_GOAL = r"(?i)(The ultimate goal is to bring about behavior changes and the use of .*?best management practices.*?overall quality of life in the watershed\.)"
STREAM_KEYS = ("the ultimate goal", "the overall goal", "the primary goal", "primary goal", "overall goal", "main goal", "goal is to")
REPAIR_KEYS = ("the ultimate goal", "overall goal", "primary goal", " goal ")
OBJECTIVE = r"(?i)((?:The\s+)?goal and objective is to[^.]{10,300}\.)"
ANCHORED_GOAL = r"(?i)^\s*goal[:\-]|\bgoal:"
SEMANTIC_GOAL = r"(?i)(ultimate goal|overall goal|primary objective|main objective|intended outcome|mission is to)"
FALLBACK_SECTIONS = ("Monitoring", "Implementation", "BMPs", "Outreach")
LIST_ANCHOR = r"(?i)(These\s+BMPs\s+include[^\n]*:|These\s+BMPs\s+will[^\n]*:|The\s+BMPs\s+include[^\n]*:)"
LISTED_NAME = r"^\s*(?:[•\-*]\s+)?[A-Z][A-Za-z0-9 /&()'-]{2,}$"
ADMINISTRATION = r"(?i)^(total|technical assistance|education and outreach|monitoring|project management)$"
TABLE_HEAD_NAME = r"(?i)^bmps\*?$"

#: Reason, its flag and weight, in the order in which reasons are listed.
REASONS: Sequence[tuple[str, str, float]] = (
    ("starts_bad_token", "starts_bad", 2.5),
    ("schedule_fragment", "schedule_fragment", 1.5),
    ("cost_context", "cost_context", 2.0),
    ("numeric_punct_heavy", "numeric_punct_heavy", 1.2),
    ("too_short", "too_short", 1.5),
    ("too_long", "too_long", 1.0),
    ("header_case", "looks_header", 1.2),
    ("phase_token", "phase_token", 0.8),
    ("time_range", "time_range", 0.8),
    ("meta_only", "meta_only", 0.7),
    ("metrics_only", "metrics_only", 0.7),
)


def status(text: Column) -> Column:
    """completed, in_progress or planned, by what the text says."""
    return first_rule(text, [(r"(?i)completed|achieved|done|met\b", "completed"), (r"(?i)in progress|ongoing|underway", "in_progress")], "planned")


def goal_attributes(text: Column) -> dict[str, Column]:
    """Every attribute of a goal's sentence, by name."""
    by_verb, inline = number(extract(text, PERCENT_VERB, 3)), number(extract(text, PERCENT_INLINE, 1))
    years = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))
    deadline = extract(text, DEADLINE)
    paired = text.rlike(BASELINE_TARGET)
    target = F.when(paired, number(extract(text, BASELINE_TARGET, 3))).otherwise(number(extract(text, QUANTITY, 1)))
    return {
        "status": status(text),
        "pollutant": F.lower(extract(text, POLLUTANTS)),
        "reduction_percent": F.coalesce(by_verb, inline),
        "reduction_src": F.when(by_verb.isNotNull(), "verb_pattern").when(inline.isNotNull(), "inline"),
        "baseline_value": number(extract(text, BASELINE_TARGET, 1)),
        "baseline_unit": extract(text, BASELINE_TARGET, 2),
        "target_value": target,
        "target_unit": F.when(paired, extract(text, BASELINE_TARGET, 4)).otherwise(extract(text, QUANTITY, 2)),
        "load_reduction_value": number(extract(text, LOAD, 2)),
        "load_reduction_unit": extract(text, LOAD, 3),
        "achieved_value": number(extract(text, ACHIEVED, 2)),
        "achieved_unit": extract(text, ACHIEVED, 3),
        "deadline_year": deadline,
        "deadline": F.concat(deadline, F.lit("-12-31")),
        "baseline_year": F.get(years, F.lit(0)),
        "achieved_year": F.when(F.size(years) > 1, F.get(years, F.size(years) - 1)),
        "target_year": F.when(deadline.isNull() & (F.size(years) > 0), F.get(years, F.size(years) - 1)),
        "responsible": F.trim(extract(text, RESPONSIBLE, 2)),
    }


def goal_score() -> Column:
    """Confidence of a row with the goal attributes."""
    has = lambda c: F.col(c).isNotNull()
    pair = has("baseline_value") & has("target_value")
    weights = ((has("pollutant"), 0.2), (has("reduction_percent"), 0.2), (pair, 0.2), (has("deadline_year"), 0.15), (has("responsible"), 0.1), (has("load_reduction_value"), 0.15), (has("achieved_value"), 0.1), (has("pollutant") & (has("reduction_percent") | pair), 0.05))
    total = sum((F.when(test, F.lit(w)).otherwise(0.0) for test, w in weights), F.lit(0.0))
    return F.least(F.lit(0.9), F.round(total, 6))


def goal_admitted(text: Column) -> Column:
    """A primary phrase, a quantity, or a pollutant with a verb of improvement; headings are not."""
    heading = text.rlike(HEADING_WORDS) & ~text.rlike(IMPROVES) & (F.size(F.split(text, r"\s+")) < 8)
    reduction = text.rlike(PERCENT_INLINE) | text.rlike(PERCENT_VERB)
    verb = text.rlike(POLLUTANTS) & text.rlike(IMPROVES_POLLUTANT)
    return ~heading & (text.rlike(ADMITTED) | text.rlike(QUANTITATIVE) | reduction | text.rlike(BASELINE_TARGET) | verb)


def goals(lined: DataFrame) -> DataFrame:
    """Goals of (doc_id, lines): admitted clauses, then sentences and lines that speak of goals, scored and ranked.

    ``via`` tells the branch: 1 admitted, 2 a sentence with ``goal``, 3 a line with ``goal``;
    the latter two count for 0.9 of their score, and only where nothing before had the same text.
    """
    joined = ln.join_wrapped(F.col("lines"))
    clauses = F.flatten(F.transform(joined, ln.clauses))
    tidy = lambda c: F.trim(plain_quotes(c))
    first = F.transform(F.flatten(F.transform(clauses, ln.sentences)), tidy)
    second = F.transform(F.filter(ln.sentences(F.array_join("lines", " ")), lambda s: s.rlike(GOAL_WORD) & (token_count(s) >= 4)), tidy)
    third = F.transform(F.filter(F.col("lines"), lambda s: s.rlike(GOAL_WORD) & ~s.rlike(GOAL_HEADING) & (token_count(s) >= 3)), tidy)
    branch = lambda texts, n: F.transform(texts, lambda s, i: F.struct(F.lit(n).alias("via"), i.alias("pos"), s.alias("title")))
    candidates = lined.select("doc_id", F.explode(F.concat(branch(F.filter(first, lambda s: (s != "") & goal_admitted(s)), 1), branch(second, 2), branch(third, 3))).alias("c")).select("doc_id", "c.*")
    same = Window.partitionBy("doc_id", F.lower("title")).orderBy("via", "pos")
    candidates = candidates.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    found = candidates.select("*", *[c.alias(name) for name, c in goal_attributes(F.col("title")).items()])
    found = found.withColumn("confidence", F.round(goal_score() * F.when(F.col("via") > 1, 0.9).otherwise(1.0), 6))
    return classify_primary(found)


def classify_primary(found: DataFrame) -> DataFrame:
    """Explicit phrases make goals primary (+0.05); else the best 30 percent (1 to 3) of those with substance; else the best one."""
    w = Window.partitionBy("doc_id")
    explicit = F.col("title").rlike(PRIMARY)
    substance = F.col("pollutant").isNotNull() | F.col("reduction_percent").isNotNull() | (F.col("baseline_value").isNotNull() & F.col("target_value").isNotNull())
    found = found.withColumn("_any", F.max(explicit.cast("int")).over(w)).withColumn("_cand", F.sum(substance.cast("int")).over(w))
    order = (F.col("confidence").desc(), F.col("via"), F.col("pos"))
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", substance).orderBy(*order))).withColumn("_top", F.row_number().over(w.orderBy(*order)))
    pick = substance & (F.col("_rank") <= F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(F.col("_cand") * 0.3))))
    reason = F.when(explicit, "explicit_phrase").when((F.col("_any") == 0) & pick, "top_scoring").when((F.col("_any") == 0) & (F.col("_cand") == 0) & (F.col("_top") == 1), "fallback_top_confidence")
    confidence = F.when(explicit, F.least(F.lit(0.99), F.round(F.col("confidence") + 0.05, 6))).otherwise(F.col("confidence"))
    return found.withColumn("primary_reason", reason).withColumn("is_primary", reason.isNotNull()).withColumn("confidence", confidence).drop("_any", "_cand", "_rank", "_top")


def consolidate_goals(found: DataFrame, least_words: int = 8) -> DataFrame:
    """Titles without heading noise, long ones first; short ones and those inside a longer kept one go.

    A document's goals are few, so the greedy rule folds over their array in the row.
    """
    title = F.col("title")
    for noise in TITLE_NOISE:
        title = F.regexp_replace(title, noise, "")
    title = F.trim(F.regexp_replace(title, r"\s+", " "))
    focus = F.locate("goal and objective is to", F.lower(title))
    title = F.when(focus > 0, F.regexp_replace(F.substring(title, focus, F.length(title)), "(?i)^goal and objective is to", "The goal and objective is to")).otherwise(title)
    cleaned = found.withColumn("_lower", F.lower("title")).withColumn("title", title)
    every = F.array_sort(F.collect_list(F.struct((-F.length("_lower")).alias("o"), F.col("via"), F.col("pos"), F.col("_lower").alias("lower"), F.col("title"))))
    empty = F.array().cast("array<struct<o:int,via:int,pos:int,lower:string,title:string>>")

    def step(kept: Column, g: Column) -> Column:
        inside = F.exists(kept, lambda k: F.contains(F.lower(k["title"]), g["lower"]) & (F.length(k["title"]) != F.length(g["lower"])))
        return F.when((F.size(F.split(g["title"], r"\s+")) < least_words) | inside, kept).otherwise(F.concat(kept, F.array(g)))

    chosen = cleaned.groupBy("doc_id").agg(F.aggregate(every, empty, step).alias("k")).select("doc_id", F.posexplode("k").alias("n", "k"))
    chosen = chosen.select("doc_id", F.col("k.via").alias("via"), F.col("k.pos").alias("pos"), F.concat(F.lit("G"), (F.col("n") + 1).cast("string")).alias("id"))
    return cleaned.drop("_lower").join(chosen, ["doc_id", "via", "pos"]).withColumn("short_title", short_title(F.col("title")))


# A document whose text has a known goal sentence has that goal alone.  Each way to
# find one has its own confidence and reason.


def canonical_goal(raw: Column) -> Column:
    """The sentence of the ultimate goal, from its known start to ``watershed.``, within 1,500 characters; else null."""
    at = F.locate(ULTIMATE, F.lower(raw))
    window = F.substring(raw, at, F.lit(1500))
    return F.when(at > 0, F.trim(plain_quotes(extract(window, r"(?is)^(.*?watershed\.)"))))


def known_goal(joined: Column) -> Column:
    """The whole goal of a plan that is known by its title and its goal's start; else null."""
    return F.when(joined.rlike(KNOWN_PLAN) & joined.rlike(KNOWN_START), F.trim(extract(plain_quotes(joined), KNOWN_GOAL)))


def streamed_goal(raw: Column) -> Column:
    """From the earliest key phrase on, up to ``watershed.`` or the first long sentence; only where a goal breaks off at ``use of``."""
    low = F.lower(raw)
    at = F.least(*[F.nullif(F.locate(k, low), F.lit(0)) for k in STREAM_KEYS])
    broken = raw.rlike(BROKEN_TEXT) & raw.rlike(ULTIMATE_LINE) & ~raw.rlike(WHOLE_TEXT)
    window = F.trim(plain_quotes(F.substring(raw, at, F.lit(1000))))
    plain = extract(window, r"^(.*?\.)")
    return F.when(broken & at.isNotNull(), F.coalesce(extract(window, r"(?i)^(.*?watershed\.)"), F.when(F.length(plain) >= 40, plain)))


def objective_goal(joined: Column) -> Column:
    """A sentence that starts with ``goal and objective is to``; it stands for all goals that were found."""
    return F.trim(F.regexp_replace(extract(joined, OBJECTIVE), r"\s+", " "))


def repaired_goal(raw: Column) -> Column:
    """What replaces a single goal that breaks off at ``use of``: the raw sentence of the first key phrase, if it ends in ``watershed.``"""
    plain = F.regexp_replace(raw, r"\r", "")
    low = F.lower(plain)
    at = F.coalesce(*[F.nullif(F.locate(k, low), F.lit(0)) for k in REPAIR_KEYS])
    sentence = F.trim(plain_quotes(extract(F.substring(plain, at, F.lit(1000)), r"(?s)^(.*?\.)")))
    return F.when(sentence.rlike("(?i)goal") & sentence.rlike(r"(?i)watershed\."), sentence)


def goal_lines(goals: Column, every: Column) -> Column:
    """The lines that goals are sought in: a goal that breaks off at ``use of`` brings all section lines in, and its rebuilt sentence."""
    broken = F.exists(goals, lambda x: x.rlike(ULTIMATE_LINE) & F.trim(x).rlike(BROKEN_LINE))
    text = plain_quotes(F.array_join(every, "\n"))
    at = F.locate(ULTIMATE, F.lower(text))
    window = F.substring(text, at, F.lit(600))
    sentence = F.trim(F.coalesce(extract(window, r"(?i)^(.*?quality of life in the watershed\.)"), extract(window, r"(?i)^(.*?watershed\.)")))
    rebuilt = (at > 0) & sentence.rlike("(?i)best management practices") & sentence.rlike("(?i)overall quality of life")
    extra = F.when(rebuilt, F.array(sentence)).otherwise(F.array().cast("array<string>"))
    return F.when(broken, F.concat(F.array_distinct(F.concat(goals, every)), extra)).otherwise(goals)


SOLE = "struct<title:string,confidence:double,reason:string>"


def sole(title: Column, confidence: float, reason: str) -> Column:
    return F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason")))


def sole_goals(found: DataFrame) -> DataFrame:
    """(doc_id, sole) as goals: status and pollutant are the only attributes of theirs."""
    title = F.col("sole.title")
    attributes = {n: (c if n in ("status", "pollutant") else F.lit(None).cast("double" if n.endswith(("value", "percent")) else "string")) for n, c in goal_attributes(title).items()}
    return found.where("sole IS NOT NULL").select(
        "doc_id", F.lit(0).alias("via"), F.lit(0).alias("pos"), title.alias("title"), *[c.alias(n) for n, c in attributes.items()], F.col("sole.confidence").alias("confidence"), F.col("sole.reason").alias("primary_reason"),
        F.lit(True).alias("is_primary"), F.lit("G1").alias("id"), short_title(title).alias("short_title"),
    )


def extracted_goals(lined: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Goals of (doc_id, lines) by the whole chain: known sentence, broken sentence, admission and consolidation, objective.

    ``write`` cuts the lineage of what several steps read.
    """
    joined = F.array_join("lines", "\n")
    early = F.coalesce(sole(known_goal(joined), 0.65, "early_canonical_dry_creek"), sole(streamed_goal(joined), 0.80, "simple_stream_capture"))
    lined = write(lined.select("doc_id", "lines", early.alias("sole"), sole(objective_goal(joined), 0.40, "canonical_phrase").alias("objective")), "goal-lines")
    found = write(goals(lined.where("sole IS NULL").select("doc_id", "lines")), "goals")
    aims = found.select("doc_id").distinct().join(lined.where("sole IS NULL AND objective IS NOT NULL").select("doc_id", F.col("objective").alias("sole")), "doc_id")
    rest = consolidate_goals(found.join(aims.select("doc_id"), "doc_id", "left_anti"))
    return rest.unionByName(sole_goals(lined)).unionByName(sole_goals(aims))


def fallback_lines(by_section: Callable[..., Column], every: Column) -> Column:
    """array<struct<stage, lines>> where goals are sought in a document without: ``goal:`` lines, sentences with goal, phrases of purpose."""
    anchored = F.filter(by_section(*FALLBACK_SECTIONS), lambda x: x.rlike(ANCHORED_GOAL))
    parts = lambda lines, pattern: F.transform(F.filter(F.flatten(F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.split(x, r"(?<=[.!?])\s+"))), lambda s: s.rlike(pattern)), lambda s: F.trim(s))
    stages = (anchored, parts(every, "(?i)goal"), parts(by_section("uncategorized"), SEMANTIC_GOAL))
    return F.filter(F.array(*[F.struct(F.lit(i + 1).alias("stage"), lines.alias("lines")) for i, lines in enumerate(stages)]), lambda x: F.size(x["lines"]) > 0)


def fallback_goals(staged: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, stages) of documents without goals: the goals of the first stage that gives any; ``stage`` tells which."""
    lined = staged.select("doc_id", F.explode("stages").alias("s")).select(F.struct("doc_id", "s.stage").alias("doc_id"), "s.lines")
    found = write(extracted_goals(lined, write), "fallback-goals")
    first = found.select("doc_id.*").groupBy("doc_id").agg(F.min("stage").alias("stage"))
    return found.withColumn("stage", F.col("doc_id.stage")).withColumn("doc_id", F.col("doc_id.doc_id")).join(first, ["doc_id", "stage"], "left_semi")


def repair_single(found: DataFrame, repairs: DataFrame) -> DataFrame:
    """A document's only goal that breaks off at ``use of`` takes the sentence of repairs (doc_id, repair)."""
    broken = found.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("_broken", (F.col("_n") == 1) & F.col("title").rlike(BROKEN_LINE))
    j = broken.join(repairs.where("repair IS NOT NULL").select("doc_id", "repair"), "doc_id", "left").withColumn("_hit", F.col("_broken") & F.col("repair").isNotNull())
    take = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old)).alias(old)
    changed = {
        "title": F.col("repair"), "short_title": short_title(F.col("repair")), "confidence": F.greatest(F.col("confidence"), F.lit(0.85)),
        "primary_reason": F.coalesce("primary_reason", F.lit("raw_stream_fallback")), "is_primary": F.lit(True),
    }
    return j.select(*[take(changed[c], c) if c in changed else F.col(c) for c in found.columns])


# --- practices ---


def practice(line: Column) -> dict[str, Column]:
    """Attributes of a practice line."""
    keyword = F.coalesce(*[extract(line, f"(?i)({pattern.removeprefix('(?i)')})", 1) for pattern, _ in BMP_CATEGORIES])
    quantity, verb = number(extract(line, QUANTITY, 1)), F.lower(extract(line, VERB))
    score = (
        F.when(keyword.isNotNull(), 0.3).otherwise(0.0) + F.when(quantity.isNotNull(), 0.25).otherwise(0.0) + F.when(verb.isNotNull(), 0.15).otherwise(0.0) + F.when(keyword.isNotNull(), 0.1).otherwise(0.0)
        + F.when(line.rlike(r"\d{4}"), 0.05).otherwise(0.0) + F.when(line.rlike("(?i)maintenance|maintain"), 0.05).otherwise(0.0)
    )
    return {
        "name": F.trim(line), "category": first_rule(line, BMP_CATEGORIES, "General"), "keyword": keyword, "quantity": quantity, "unit": extract(line, QUANTITY, 2), "verb": verb,
        "confidence": F.least(F.lit(0.95), F.round(score, 6)), "source": line,
    }


def practices(lined: DataFrame) -> DataFrame:
    """Every line of (doc_id, lines), wrapped ones joined, as a practice with its place."""
    rows = lined.select("doc_id", F.posexplode(ln.join_wrapped(F.col("lines"))).alias("pos", "line"))
    return rows.select("doc_id", "pos", *[c.alias(n) for n, c in practice(F.col("line")).items()])


def refine_category(name: Column, category: Column) -> Column:
    return F.coalesce(first_rule(name, REFINED_CATEGORIES, None), category)


def refined(found: DataFrame) -> DataFrame:
    """Practices with finer categories; a change adds 0.1 of confidence and a tag."""
    category = refine_category(F.col("name"), F.col("category"))
    changed = category != F.col("category")
    more, tagged = F.least(F.lit(0.95), F.round(F.coalesce("confidence", F.lit(0.3)) + 0.1, 6)), F.concat_ws("|", "source", F.lit("category_refine"))
    return found.withColumns({"category": category, "confidence": F.when(changed, more).otherwise(F.col("confidence")), "source": F.when(changed, tagged).otherwise(F.col("source"))})


def summary_line_practices(lines: DataFrame, known: DataFrame, fewer_than: int = 3) -> DataFrame:
    """Documents with few practices get those of lines such as ``Ag BMP $3,803,456``, behind their own; known ones gain confidence.

    lines: (doc_id, pos, line) of all sections; known: (doc_id, pos, name, category, confidence, source, …).
    """
    enough = known.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= fewer_than).select("doc_id")
    named = lines.select("doc_id", "pos", F.trim(extract(F.trim("line"), SUMMARY_LINE)).alias("name"), F.trim("line").alias("line")).where("name is not null and lower(name) <> 'total'")
    named = named.join(enough, "doc_id", "left_anti").groupBy("doc_id", F.lower("name").alias("_key"))
    first = named.agg(F.min_by(F.struct("pos", "name", "line"), "pos").alias("_first"))
    first = first.select("doc_id", "_key", F.col("_first.pos").alias("_pos"), F.col("_first.name").alias("_name"), F.concat(F.lit("summary_line:"), F.col("_first.line")).alias("_tag"))
    j = known.withColumn("_key", F.lower("name")).join(first, ["doc_id", "_key"], "full")
    new, hit = F.col("name").isNull() & F.col("_name").isNotNull(), F.col("_name").isNotNull()
    changed = {
        "pos": F.when(new, F.col("_pos") + F.lit(BEHIND)).otherwise(F.col("pos")).cast(known.schema["pos"].dataType),
        "name": F.coalesce("name", "_name"), "category": F.when(new, last_rule(F.col("_name"), SUMMARY_CATEGORIES, "General")).otherwise(F.col("category")),
        "confidence": F.round(F.when(new, 0.25).when(hit, F.least(F.lit(0.9), F.greatest("confidence", F.lit(0.55)))).otherwise(F.col("confidence")), 6),
        "source": F.when(new, F.col("_tag")).when(hit & ~F.coalesce(F.col("source"), F.lit("")).contains("summary_line:"), F.concat_ws("|", "source", "_tag")).otherwise(F.col("source")),
    }
    return j.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in known.columns])


#: Places of practices that come from other lines: behind those of the section.
BEHIND = 1_000_000


def injected_cost_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Practices with those of cost rows (doc_id, pattern_id, place, name) that they lack, behind them; heads and administration are left out."""
    name = F.trim(F.regexp_replace("name", r"\*+$", ""))
    named = rows.select("doc_id", "pattern_id", "place", name.alias("name")).where((F.col("name") != "") & ~F.col("name").rlike(TABLE_HEAD_NAME) & ~F.col("name").rlike(ADMINISTRATION))
    first = named.groupBy("doc_id", F.lower("name").alias("_k")).agg(F.min_by(F.struct("name", "pattern_id", "place"), F.struct("place", "name")).alias("f"))
    new = first.join(known.select("doc_id", F.lower("name").alias("_k")).distinct(), ["doc_id", "_k"], "left_anti").select("doc_id", "f.*")
    new = new.select("doc_id", (F.col("place") + F.lit(BEHIND // 2)).cast("int").alias("pos"), "name", F.lit("General").alias("category"), F.lit(0.32).alias("confidence"), F.concat_ws(":", F.lit("cost_table_row"), "pattern_id", "name").alias("source"))
    return known.unionByName(new, allowMissingColumns=True)


def both_sources(found: DataFrame) -> DataFrame:
    """Practices that a cost row and a summary line give have a confidence of 0.6 at least."""
    both = F.col("source").contains("cost_table_row:") & F.col("source").contains("summary_line:")
    return found.withColumn("confidence", F.when(both, F.greatest("confidence", F.lit(0.6))).otherwise(F.col("confidence")))


def trimmed_names(found: DataFrame) -> DataFrame:
    """Names without cost tails; where any name of a document was cut, the first of each name stays, case aside."""
    name = cost_tail_cut(F.col("name"))
    cut = F.coalesce(name != F.col("name"), F.lit(False))
    tag = F.lit("name_cost_tail_trim")
    found = found.withColumn("original_name", F.when(cut, F.col("name"))).withColumn("source", F.when(cut, F.concat_ws("|", "source", tag)).otherwise(F.col("source"))).withColumn("name", name)
    any_cut = F.max(F.col("original_name").isNotNull()).over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy("pos"))
    kept = ~F.col("_any") | ((F.col("_n") == 1) & (F.coalesce(F.col("name"), F.lit("")) != ""))
    return found.withColumn("_any", any_cut).withColumn("_n", place).where(kept).drop("_any", "_n")


def practices_from_costs(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Names of cost rows that the document's practices lack, as practices of low confidence."""
    names = rows.select("doc_id", F.trim(F.regexp_replace("name", r"\*", "")).alias("name")).where("name <> '' and lower(name) <> 'total'").distinct()
    new = names.withColumn("_k", F.lower("name")).join(known.select("doc_id", F.lower("name").alias("_k")).distinct(), ["doc_id", "_k"], "left_anti")
    return new.select("doc_id", "name", F.lit("General").alias("category"), F.lit(0.30).alias("confidence"), F.lit("cost_table_row").alias("source"))


def listed_practices(raw: Column) -> Column:
    """Names listed behind ``These BMPs include …:``: capitalised lines up to a total or a sentence, each once."""
    at = F.regexp_instr(raw, F.lit(LIST_ANCHOR))
    start = at + F.length(F.regexp_extract(raw, LIST_ANCHOR, 1))
    lines = F.filter(F.transform(F.split(F.substring(raw, start, F.lit(1200)), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(a: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"[,;:.]+$", "")
        fits = bare.rlike(LISTED_NAME)
        name = F.trim(F.regexp_replace(F.regexp_replace(line, r"^[•\-*]\s+", ""), r"[,;:.]+$", ""))
        ends = F.when(fits, name.rlike("(?i)^(?:Total|Summary)$")).otherwise((F.size(a["out"]) > 0) & line.contains("."))
        taken = ~a["done"] & fits & ~ends & (F.size(F.split(name, r"\s+")) <= 12) & ~F.exists(a["out"], lambda x: F.lower(x) == F.lower(name))
        return F.struct(F.when(taken, F.concat(a["out"], F.array(name))).otherwise(a["out"]).alias("out"), (a["done"] | ends).alias("done"))

    return F.when(at > 0, F.aggregate(lines, empty, step, lambda a: a["out"])).otherwise(F.array().cast("array<string>"))


# --- the noise filter ---


def noise_flags(name: Column) -> dict[str, Column]:
    """action_like and the flags of a practice name, by name; ``reject`` sums them up."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    low = F.lower(raw)
    n = token_count(low)
    action = low.rlike(ACTION) | low.rlike(VERBISH)
    phase, span, percent = low.rlike(PHASE), low.rlike(TIME_RANGE), low.rlike(PERCENT)
    flags = {
        "starts_bad": low.rlike(STARTS_BAD),
        "schedule_fragment": low.rlike(SCHEDULE),
        "cost_context": low.rlike(COST_ONLY) | (low.rlike(COST_WORD) & ~action),
        "numeric_punct_heavy": F.length(F.regexp_replace(raw, "(?i)[a-z]", "")) / F.greatest(F.lit(1), F.length(raw)) > 0.65,
        "too_short": n < 2,
        "too_long": (n > 30) & ~action,
        "looks_header": raw.rlike("^[A-Z ]{6,}$") & ~action,
        "phase_token": phase,
        "time_range": span,
        "percent_token": percent,
        "meta_only": (phase | span) & ~action & (n < 8),
        "metrics_only": percent & ~action & (n < 6),
    }
    anything = F.lit(False)
    for flag in flags.values():
        anything = anything | flag
    return {"action_like": action, **flags, "reject": anything & ~action}


def reject_reasons() -> Column:
    """The reasons of a row with the noise flags, first one primary; ``generic`` if none applies."""
    reasons = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(reason)) for reason, flag, _ in REASONS]))
    return F.when(F.size(reasons) == 0, F.array(F.lit("generic"))).otherwise(reasons)


def reject_confidence() -> Column:
    total = sum((F.when(F.col(flag), F.lit(w)).otherwise(0.0) for _, flag, w in REASONS), F.lit(0.0)) - F.when(F.col("action_like"), 1.0).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 2)


def retention_confidence(name: Column) -> Column:
    n = token_count(name)
    action = name.rlike(ACTION) | name.rlike(VERBISH)
    total = F.lit(3.0) + F.when(action, 3.0).otherwise(0.0) + F.when((n >= 3) & (n <= 14), 2.0).otherwise(0.0) + F.when(name.rlike(RETAINED), 1.5).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), total)), 2)


def filter_practices(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) of rows with a name: both come from one projection of flags."""
    flagged = found.select("*", *[c.alias(n) for n, c in noise_flags(F.col("name")).items()])
    kept = flagged.where(~F.col("reject")).select(*found.columns, retention_confidence(F.col("name")).alias("filter_confidence"))
    rejected = flagged.where("reject").withColumn("reject_reasons", reject_reasons()).withColumn("reject_primary", F.get("reject_reasons", F.lit(0))).withColumn("reject_confidence", reject_confidence())
    return kept, rejected


def dedupe_practices(found: DataFrame) -> DataFrame:
    """Per document and canonical name the most confident, at the first one's place."""
    w = Window.partitionBy("doc_id", "_c")
    ranked = found.withColumn("_c", canonical_name(F.col("name"))).withColumn("_place", F.min("pos").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col("confidence").desc(), "pos")))
    return ranked.where("_n = 1").withColumn("pos", F.col("_place")).drop("_c", "_place", "_n")


def numbered(rows: DataFrame, prefix: str, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Ids by place within the document: G1, B1, …"""
    return rows.withColumn("id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("string")))


# --- activities and plain sections ---


def activity(line: Column) -> dict[str, Column]:
    cost = extract(line, COST)
    value = F.when(F.lower(cost).endswith("k"), number(F.regexp_replace(F.lower(cost), "k", "")) * 1000).otherwise(number(cost))
    years = F.regexp_extract_all(line, F.lit(YEAR), F.lit(1))
    fields = {
        "verb": F.lower(extract(line, VERB)), "frequency": F.lower(extract(line, FREQUENCY)), "due_year": F.when(F.size(years) > 0, F.get(years, F.size(years) - 1)), "responsible": F.trim(extract(line, RESPONSIBLE, 2)), "cost_value": value,
    }
    known = sum((F.when(fields[k].isNotNull(), 0.15).otherwise(0.0) for k in ("frequency", "due_year", "responsible", "cost_value")), F.lit(0.25))
    score = known + F.when(fields["verb"].isin("monitor", "sample"), 0.05).otherwise(0.0)
    return {"description": line, "object": line, **fields, "cost_unit": F.when(value.isNotNull(), F.lit("USD")), "confidence": F.least(F.lit(0.95), F.round(score, 6))}


def activities(lined: DataFrame) -> DataFrame:
    """Lines of (doc_id, lines), wrapped ones joined, that have a verb of action."""
    rows = lined.select("doc_id", F.posexplode(ln.join_wrapped(F.col("lines"))).alias("pos", "line")).where(F.col("line").rlike(VERB))
    return rows.select("doc_id", "pos", *[c.alias(n) for n, c in activity(F.col("line")).items()])


def implementation(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.regexp_replace("id", "^A", "I").alias("id"), "description", F.concat(F.col("due_year"), F.lit("-01-01")).alias("date"), F.lit(None).cast("double").alias("target"), F.lit(None).cast("double").alias("achieved"))


def plain_section(sections: DataFrame, section: str, prefix: str, name: str) -> DataFrame:
    """A section's lines as rows with ids; monitoring has no values, outreach gets an audience."""
    from siltstone.functions.text import audience

    rows = numbered(sections.where(F.col("section") == section), prefix).select("doc_id", "id", F.trim("line").alias(name), F.col("line").alias("source"))
    return rows.withColumn("audience", audience(F.col("source"))) if section == "Outreach" else rows
