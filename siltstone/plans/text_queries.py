"""Queries over lines and texts: the line model, entities, filters, names and readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.operators import analytics as an
from siltstone.operators import cost_engine as ce
from siltstone.operators import entities as en
from siltstone.operators import lines as ln
from siltstone.plans.registry import Tables, query
from siltstone.sources import documents as src


def flat(docs: DataFrame) -> DataFrame:
    return ln.explode_lines(docs, "doc_id", "text")


@query("line_stats", r"""WITH l AS (SELECT lang, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents)
SELECT lang, count(*)::BIGINT AS n_lines, count(*) FILTER (line <> '')::BIGINT AS filled, sum(length(line))::BIGINT AS characters, max(length(line))::BIGINT AS longest FROM l GROUP BY 1""")  # fmt: skip
def line_stats(t: Tables) -> DataFrame:
    lines = t.documents.select("lang", F.explode(F.split("text", r"\r?\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), an.count_if(F.col("line") != "").alias("filled"), F.sum(F.length("line")).cast("long").alias("characters"), F.max(F.length("line")).cast("long").alias("longest"))


@query("section_carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_carry_forward(t: Tables) -> DataFrame:
    return ln.carry_forward(t.conversations, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query("section_lines", r"""WITH l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1)
SELECT s.section, s.rank AS section_rank, sum(l.n * s.k)::BIGINT AS n FROM l, (VALUES ('uncategorized', 6, 1), ('Goals', 0, 2), ('BMPs', 1, 1)) s(section, rank, k) GROUP BY ALL""")  # fmt: skip
def section_lines(t: Tables) -> DataFrame:
    """Texts with headers put in: before the first is uncategorized, Goals twice, BMPs once."""
    body = F.col("text")
    docs = t.documents.select("doc_id", F.concat_ws("\n", body, F.lit("GOALS:"), body, F.lit(" bmps "), body, F.lit("goals"), body).alias("text"))
    return ln.section_lines(docs, "doc_id", "text").groupBy("section", "section_rank").agg(F.count("*").alias("n"))


@query("cue_sections", r"""WITH l AS (SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text || chr(10) || 'The goal costs $' || doc_id, '\n') AS ls FROM documents)) WHERE trim(line) <> ''),
k AS (SELECT doc_id, pos, 'Goals' AS section FROM l WHERE line LIKE 'The goal costs%' UNION ALL SELECT doc_id, pos, 'BMPs' FROM l WHERE line LIKE 'The goal costs%' UNION ALL SELECT doc_id, pos, 'uncategorized' FROM l WHERE line NOT LIKE 'The goal costs%')
SELECT section, count(*)::BIGINT AS n FROM k GROUP BY 1""")  # fmt: skip
def cue_sections(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat("text", F.lit("\nThe goal costs $"), F.col("doc_id").cast("string")).alias("text"))
    return ln.cue_sections(docs, "doc_id", "text").groupBy("section").agg(F.count("*").alias("n"))


@query("cost_sections", r"""WITH l AS (SELECT unnest(regexp_split_to_array(text || chr(10) || 'Fence $' || doc_id, '\n')) AS line FROM documents)
SELECT CASE WHEN regexp_matches(line, '\$[0-9]') THEN 'BMPs' ELSE 'uncategorized' END AS section, count(*)::BIGINT AS n FROM l WHERE trim(line) <> '' GROUP BY 1""")  # fmt: skip
def cost_sections(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat("text", F.lit("\nFence $"), F.col("doc_id").cast("string")).alias("text"))
    return ln.cost_sections(docs, "doc_id", "text").groupBy("section").agg(F.count("*").alias("n"))


@query("chunk_reassemble", """SELECT doc_id, greatest(1, ceil(length(text) / 18000.0))::BIGINT AS n_parts, sha1(text) AS digest FROM documents""")
def chunk_reassemble(t: Tables) -> DataFrame:
    whole = ln.reassemble(ln.chunks(t.documents, "doc_id", "text"), "doc_id", "")
    return whole.select("doc_id", "n_parts", F.sha1(F.col("text").cast("binary")).alias("digest"))


@query("whole_first", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(text) ELSE length(text) + 2 * (greatest(1, ceil(length(text) / 5000.0)) - 1) END::BIGINT AS n FROM documents""")
def whole_first(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    parts = ln.chunks(docs, "doc_id", "text", 5000)
    both = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("int").alias("part"), "text").unionByName(parts)
    return src.whole_first(both).select("doc_id", F.length("text").cast("long").alias("n"))


@query("wrapped_join_counts", None)
def wrapped_join_counts(t: Tables) -> DataFrame:
    return ce.document_lines(t.documents, keep_blank=True).select("doc_id", F.size("lines").alias("lines"), F.size(ln.join_wrapped(F.col("lines"))).alias("joined"))


@query("sentence_counts", None)
def sentence_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(ln.sentences(F.regexp_replace("text", r"\s+", " "))).alias("sentences"))


@query("line_completion", r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents)
SELECT doc_id, count(*)::BIGINT AS n FROM l WHERE line LIKE '%.%' OR (doc_id, line) NOT IN (SELECT doc_id, line FROM l WHERE line LIKE '%.%') GROUP BY 1""")  # fmt: skip
def line_completion(t: Tables) -> DataFrame:
    lines = flat(t.documents)
    return ln.complete_lines(lines.where(F.col("line").contains(".")), lines, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


# --- entities rendered from the star schema ---

def goal_sentence() -> Column:
    return F.format_string("The goal is to reduce sediment by %d percent and cut %d lbs to %d lbs by %d, lead: Clerk %d.", (F.col("o_orderkey") % 90 + 5).cast("int"), (F.col("o_orderkey") % 50 + 100).cast("int"), (F.col("o_orderkey") % 40 + 10).cast("int"), F.year("o_orderdate") + 20, (F.col("o_custkey") % 100).cast("int"))


@query("goal_attributes", """SELECT o_orderkey, 'sediment' AS pollutant, (o_orderkey % 90 + 5)::DOUBLE AS reduction_percent, (o_orderkey % 50 + 100)::DOUBLE AS baseline_value, (o_orderkey % 40 + 10)::DOUBLE AS target_value,
  CAST(year(o_orderdate) + 20 AS VARCHAR) AS deadline_year, CAST(year(o_orderdate) + 20 AS VARCHAR) || '-12-31' AS deadline, 'Clerk ' || (o_custkey % 100) AS responsible, 'planned' AS status, 0.9::DOUBLE AS confidence FROM orders""")  # fmt: skip
def goal_attributes(t: Tables) -> DataFrame:
    found = t.orders.select("o_orderkey", *[c.alias(n) for n, c in en.goal_attributes(goal_sentence()).items()])
    return found.select("o_orderkey", "pollutant", "reduction_percent", "baseline_value", "target_value", "deadline_year", "deadline", "responsible", "status", en.goal_score().alias("confidence"))


@query("goal_pipeline", """SELECT o_orderkey AS doc_id, 1::BIGINT AS goals, 1::BIGINT AS primaries, 0.95::DOUBLE AS best FROM orders""")
def goal_pipeline(t: Tables) -> DataFrame:
    """From text to ranked goals: a heading, prose, and one goal in each document."""
    text = F.concat_ws("\n", F.lit("Introduction"), F.lit("Nothing of note here."), goal_sentence(), F.lit("Appendix."))
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    found = en.consolidate_goals(en.goals(ce.document_lines(docs)))
    return found.groupBy("doc_id").agg(F.count("*").alias("goals"), an.count_if(F.col("is_primary")).alias("primaries"), F.max("confidence").alias("best"))


@query("year_extraction", """SELECT o_orderkey, CAST(year(o_orderdate) + 10 AS VARCHAR) AS first_year, CAST(year(o_orderdate) + 30 AS VARCHAR) AS last_year FROM orders""")
def year_extraction(t: Tables) -> DataFrame:
    line = F.format_string("Start in %d, done in %d", F.year("o_orderdate") + 10, F.year("o_orderdate") + 30)
    found = en.goal_attributes(line)
    return t.orders.select("o_orderkey", found["baseline_year"].alias("first_year"), found["achieved_year"].alias("last_year"))


@query("activity_extraction", """SELECT o_orderkey, 'monitor' AS verb, 'quarterly' AS frequency, CAST(year(o_orderdate) + 20 AS VARCHAR) AS due_year, 'Clerk ' || (o_custkey % 100) AS responsible, floor(o_totalprice)::DOUBLE AS cost_value, 0.9::DOUBLE AS confidence FROM orders""")
def activity_extraction(t: Tables) -> DataFrame:
    line = F.format_string("Monitor stream quarterly, lead: Clerk %d, $%s in %d", (F.col("o_custkey") % 100).cast("int"), F.format_number(F.floor("o_totalprice"), 0), F.year("o_orderdate") + 20)
    found = en.activity(line)
    return t.orders.select("o_orderkey", *[found[c].alias(c) for c in ("verb", "frequency", "due_year", "responsible", "cost_value", "confidence")])


@query("practice_extraction", """SELECT p_partkey, 'Vegetative Buffer' AS category, 'riparian buffer' AS keyword, p_size::DOUBLE AS quantity, 'acres' AS unit, 'install' AS verb, 0.8::DOUBLE AS confidence FROM part""")
def practice_extraction(t: Tables) -> DataFrame:
    found = en.practice(F.format_string("Install %d acres of riparian buffer", "p_size"))
    return t.part.select("p_partkey", *[found[c].alias(c) for c in ("category", "keyword", "quantity", "unit", "verb", "confidence")])


RULES = (("(?i)widget|gear", "Moving"), ("(?i)plate|bolt", "Fixed"), ("(?i)cold", "Cold"))


@query("bmp_category", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'widget|gear') THEN 'Moving' WHEN regexp_matches(p_name, 'plate|bolt') THEN 'Fixed' WHEN regexp_matches(p_name, 'cold') THEN 'Cold' ELSE 'General' END AS category,
  CASE WHEN regexp_matches(p_name, 'cold') THEN 'Cold' WHEN regexp_matches(p_name, 'plate|bolt') THEN 'Fixed' WHEN regexp_matches(p_name, 'widget|gear') THEN 'Moving' ELSE 'General' END AS last_category FROM part""")  # fmt: skip
def bmp_category(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.select("p_partkey", tx.first_rule(name, RULES, "General").alias("category"), tx.last_rule(name, RULES, "General").alias("last_category"))


@query("row_classifier", """WITH s AS (SELECT p_partkey, regexp_matches(p_name, 'widget|gear')::INT * 2 AS a, regexp_matches(p_name, 'plate|cold')::INT AS b, (p_size > 25)::INT AS c FROM part)
SELECT p_partkey, CASE WHEN a >= b AND a >= c AND a > 0 THEN 'a' WHEN b >= c AND b > 0 THEN 'b' WHEN c > 0 THEN 'c' ELSE 'none' END AS class, round(CASE WHEN greatest(a, b, c) > 0 THEN least(1, 0.3::DOUBLE + greatest(a, b, c) / 3) ELSE 0 END, 6) AS confidence FROM s""")  # fmt: skip
def row_classifier(t: Tables) -> DataFrame:
    """Weighted classes; the best score wins, ties go to the first class."""
    points = [("a", F.col("p_name").rlike("widget|gear").cast("int") * 2), ("b", F.col("p_name").rlike("plate|cold").cast("int")), ("c", (F.col("p_size") > 25).cast("int"))]
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, p) in enumerate(points)]))
    score = F.when(best["p"] > 0, F.least(F.lit(1.0), 0.3 + best["p"] / 3)).otherwise(0.0)
    return t.part.select("p_partkey", F.when(best["p"] > 0, best["c"]).otherwise("none").alias("class"), F.round(score, 6).alias("confidence"))


def odd_name() -> Column:
    return F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Budget "), "p_name")).when(F.col("p_partkey") % 5 == 1, F.upper("p_name")).when(F.col("p_partkey") % 5 == 2, F.concat("p_name", F.lit(" phase 2"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("install "), "p_name")).otherwise(F.lit("12/3"))


NAMED_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'Budget ' || p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' phase 2' WHEN 3 THEN 'install ' || p_name ELSE '12/3' END"


@query("noise_filter_flags", f"""WITH n AS (SELECT p_partkey, {NAMED_SQL} AS name FROM part)
SELECT p_partkey, p_partkey % 5 = 3 AS action_like, p_partkey % 5 = 0 AS starts_bad, p_partkey % 5 = 0 AS cost_context, p_partkey % 5 = 4 AS too_short, p_partkey % 5 = 1 AND length(name) >= 6 AS looks_header, p_partkey % 5 = 2 AS phase_token, p_partkey % 5 <> 3 AND NOT (p_partkey % 5 = 1 AND length(name) < 6) AS reject FROM n""")  # fmt: skip
def noise_filter_flags(t: Tables) -> DataFrame:
    flags = en.noise_flags(odd_name())
    return t.part.select("p_partkey", *[flags[c].alias(c) for c in ("action_like", "starts_bad", "cost_context", "too_short", "looks_header", "phase_token", "reject")])


@query("reject_reasons", f"""WITH n AS (SELECT p_partkey, {NAMED_SQL} AS name FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'starts_bad_token,cost_context' WHEN 1 THEN 'header_case' WHEN 2 THEN 'phase_token,meta_only' ELSE 'numeric_punct_heavy,too_short' END AS reasons,
  CASE p_partkey % 5 WHEN 0 THEN 4.5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.5 ELSE 2.7 END::DOUBLE AS confidence FROM n WHERE p_partkey % 5 <> 3""")  # fmt: skip
def reject_reasons(t: Tables) -> DataFrame:
    _, rejected = en.filter_practices(t.part.select("p_partkey", odd_name().alias("name")))
    return rejected.select("p_partkey", F.array_join("reject_reasons", ",").alias("reasons"), F.col("reject_confidence").alias("confidence"))


@query("retention_confidence", """SELECT p_partkey, (3 + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END)::DOUBLE AS confidence FROM part""")
def retention_confidence(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("install "), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", en.retention_confidence(name).alias("confidence"))


@query("reason_counts", """SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(CASE p_partkey % 5 WHEN 0 THEN ['starts_bad_token', 'cost_context'] WHEN 1 THEN ['header_case'] WHEN 2 THEN ['phase_token', 'meta_only'] WHEN 4 THEN ['numeric_punct_heavy', 'too_short'] ELSE [] END) AS reason FROM part) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def reason_counts(t: Tables) -> DataFrame:
    _, rejected = en.filter_practices(t.part.select("p_partkey", odd_name().alias("name")))
    counted = F.map_from_entries(F.transform("reject_reasons", lambda r: F.struct(r, F.lit(1).cast("long"))))
    return an.merged_reasons(rejected, counted, 5)


@query("presence_guard", """SELECT d.doc_id, contains(lower(d.text), lower(left(b.text, 40))) AS present FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id""")
def presence_guard(t: Tables) -> DataFrame:
    """Each document's own candidate text is looked up in it, by key."""
    entities = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(t.benchmark.select("item_id", F.substring("text", 1, 40).alias("entity")), "item_id")
    return an.contained_in(entities, t.documents, "doc_id", "entity", "text").select("doc_id", "present")


@query("summary_line_practices", """SELECT s_suppkey AS doc_id, 'Agric Supply' AS name, 'Agriculture' AS category, 0.25::DOUBLE AS confidence FROM supplier UNION ALL SELECT s_suppkey, 'Cover Crop', 'Vegetative', 0.55 FROM supplier""")
def summary_line_practices(t: Tables) -> DataFrame:
    lines = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.posexplode(F.array(F.lit("Agric Supply $3,456"), F.lit("Cover Crop $12,000"), F.lit("Total $99,000"), F.lit("no amount"))).alias("pos", "line"))
    known = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("pos"), F.lit("Cover Crop").alias("name"), F.lit("Vegetative").alias("category"), F.lit(0.4).alias("confidence"), F.lit("x").alias("source"))
    return en.summary_line_practices(lines, known).select("doc_id", "name", "category", "confidence")


@query("cost_row_injection", """SELECT DISTINCT l_orderkey AS doc_id, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT EXISTS (SELECT 1 FROM lineitem l2 JOIN part p2 ON l2.l_partkey = p2.p_partkey WHERE l2.l_orderkey = lineitem.l_orderkey AND l2.l_linenumber = 1 AND lower(p2.p_name) = lower(part.p_name))""")
def cost_row_injection(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("name"), "l_linenumber")
    return en.practices_from_costs(rows, rows.where("l_linenumber = 1")).select("doc_id", "name")


@query("truncation_audit", """SELECT doc_id, length(text) = 18000 OR length(text) < 120 AS suspect, length(regexp_replace(text, '\\s+', '', 'g')) < 50 AND NOT contains(text, '$') AS blank FROM documents""")
def truncation_audit(t: Tables) -> DataFrame:
    dense = F.length(F.regexp_replace("text", r"\s+", ""))
    return t.documents.select("doc_id", ((F.length("text") == 18000) | (F.length("text") < 120)).alias("suspect"), ((dense < 50) & ~F.col("text").contains("$")).alias("blank"))


@query("title_flags", """SELECT p_partkey, list_filter([CASE WHEN contains(p_name, 'cold') THEN 'cold' END, CASE WHEN length(p_name) < 11 THEN 'short' END], lambda x: x IS NOT NULL) AS flags FROM part""")
def title_flags(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_compact(F.array(F.when(F.col("p_name").contains("cold"), F.lit("cold")), F.when(F.length("p_name") < 11, F.lit("short")))).alias("flags"))


@query("report_search", """SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'cold') AND contains(lower(p_name || ' ' || p_brand), 'brand')""")
def report_search(t: Tables) -> DataFrame:
    return t.part.where(tx.search_hit(F.concat_ws(" ", "p_name", "p_brand"), "Cold  BRAND")).select("p_partkey")


@query("false_positive_guard", """SELECT p_partkey, contains(p_name, split_part(p_name, ' ', 2)) AND contains(p_name, 'cold') AS kept FROM part""")
def false_positive_guard(t: Tables) -> DataFrame:
    """A transformed name is kept if each token of more than two letters is in the original."""
    name = F.concat_ws(" ", F.get(F.split("p_name", " "), F.lit(1)), F.lit("of"), F.lit("cold"))
    tokens = F.filter(F.split(tx.comparable(name), " "), lambda x: F.length(x) > 2)
    return t.part.select("p_partkey", F.forall(tokens, lambda x: F.contains(F.col("p_name"), x)).alias("kept"))


@query("money_parse", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS amount, 'acre' AS unit, l_quantity AS quantity, 2.5::DOUBLE AS unit_cost FROM lineitem""")
def money_parse(t: Tables) -> DataFrame:
    size = tx.size_parts(F.format_string("%s ac @ $2.50/ac", F.format_number("l_quantity", 0)))
    line = F.concat(F.lit("x $"), F.format_number("l_extendedprice", 2), F.lit(" y $1"))
    return t.lineitem.select("l_orderkey", "l_linenumber", tx.money(line).alias("amount"), tx.canonical_unit(F.lit("Acres.")).alias("unit"), size["quantity"].alias("quantity"), size["unit_cost"].alias("unit_cost"))


@query("cost_tail_trim", """SELECT p_partkey, p_name AS name FROM part""")
def cost_tail_trim(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, F.lit(" 10,000 ft @ $2.50")).when(F.col("p_partkey") % 3 == 1, F.lit(": $1,200")).otherwise(F.lit(" @ $5 each"))
    return t.part.select("p_partkey", tx.cost_tail_cut(F.concat("p_name", tail)).alias("name"))


@query("compact_money", """WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderkey, '$' || CASE WHEN c >= 100000000 THEN ((c + 5000000) // 10000000) // 10 || '.' || ((c + 5000000) // 10000000) % 10 || 'M' WHEN c >= 100000 THEN ((c + 5000) // 10000) // 10 || '.' || ((c + 5000) // 10000) % 10 || 'K' ELSE ((c + 50) // 100) || '' END AS shown FROM c""")  # fmt: skip
def compact_money(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.compact_money(F.col("o_totalprice")).alias("shown"))


@query("short_titles", """SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE array_to_string(regexp_split_to_array(text, '\\s+')[1:14], ' ') || '…' END AS title FROM documents""")
def short_titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.short_title(F.col("text")).alias("title"))


@query("slugify_collisions", """WITH b AS (SELECT page_id, coalesce(nullif(trim(left(trim(regexp_replace(lower(split_part(url, '?', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 30), '-'), ''), 'document') AS b FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY page_id) AS n FROM b)
SELECT page_id, CASE WHEN n > 50 THEN b || '-' || left(sha1(b || '-' || page_id), 8) WHEN n > 1 THEN b || '-' || n ELSE b END AS slug FROM n""")  # fmt: skip
def slugify_collisions(t: Tables) -> DataFrame:
    short = t.pages.select("page_id", F.substring(tx.slug(F.get(F.split("url", r"\?"), F.lit(0))), 1, 30).alias("name"))
    return src.unique_slugs(short, "name", "page_id").select("page_id", "slug")


@query("file_slugs", """SELECT p_partkey, p_partkey || '-' || replace(p_name, ' ', '-') || '-plan' AS slug, 'plan-' || p_partkey AS family FROM part""")
def file_slugs(t: Tables) -> DataFrame:
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("_"), "p_name", F.lit(" (Plan).PDF"))
    return t.part.select("p_partkey", tx.file_slug(name).alias("slug"), tx.family(F.concat(F.lit("plan-"), F.col("p_partkey").cast("string"), F.lit("-2017-part2"))).alias("family"))


@query("link_crawl", """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*/[A-Za-z])"', 1)) AS link FROM pages""")
def link_crawl(t: Tables) -> DataFrame:
    return src.links(t.pages, "/[A-Za-z]")


@query("year_alias", """SELECT p_partkey AS k, 'doc-n' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '-2017' END AS file FROM part""")
def year_alias(t: Tables) -> DataFrame:
    ids = t.part.select(F.col("p_partkey").alias("k"), F.format_string("doc-n%d", "p_partkey").alias("id"))
    own = ids.where("k % 2 = 0").select(F.col("id").alias("file"), F.lit(1).alias("size"))
    dated = ids.select(F.concat("id", F.lit("-2015")).alias("file"), F.lit(5).alias("size")).unionAll(ids.select(F.concat("id", F.lit("-2017")).alias("file"), F.lit(9).alias("size")))
    return ids.join(src.year_alias(ids.select("id"), own.unionAll(dated)), "id").select("k", "file")


@query("page_lines", """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS doc_id, string_agg('p' || p || ' q' || q, chr(10) ORDER BY l_linenumber) AS text FROM l GROUP BY 1""")
def page_lines(t: Tables) -> DataFrame:
    """Each lineitem is two text items at one height, drawn in the wrong order."""
    item = F.explode(F.array(F.struct(F.lit(50.0).alias("x"), F.concat(F.lit("q"), F.col("l_quantity").cast("long").cast("string")).alias("t")), F.struct(F.lit(10.0).alias("x"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("t"))))
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    items = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), "l_linenumber", item.alias("i")).select("doc_id", "page", F.col("l_linenumber").alias("seq"), F.col("i.x").alias("x"), (1000.4 - 20 * F.col("l_linenumber")).alias("y"), F.col("i.t").alias("text"))
    return src.page_lines(items)


@query("top_k_signatures", """SELECT sig, count(*)::BIGINT AS n FROM (SELECT left(regexp_split_to_array(text, '\n')[1], 120) AS sig FROM documents) GROUP BY 1 ORDER BY n DESC, sig LIMIT 10""")
def top_k_signatures(t: Tables) -> DataFrame:
    signature = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 120)
    return an.top_k(t.documents.select(signature.alias("sig")).groupBy("sig").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("sig")], 10)


@query("unmatched_cost_lines", """SELECT doc_id, pos FROM (SELECT o_orderkey AS doc_id, unnest([0, 1]) AS pos, o_orderkey % 4 AS m FROM orders) WHERE pos = 0 AND m <> 0""")
def unmatched_cost_lines(t: Tables) -> DataFrame:
    """Lines with a cost cue and an amount that no detected title of the document starts with."""
    lines = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.array(F.concat(F.lit("Total Cost of the work on this and that: $"), F.format_number("o_totalprice", 2)), F.lit("plain line"))).alias("pos", "line"))
    titles = lines.where("pos = 0 and doc_id % 4 = 0").select("doc_id", F.concat(F.lit("See "), "line").alias("title"))
    cued = lines.where(F.col("line").rlike(ln.COST_HEADS) & F.col("line").rlike(r"\$[0-9,]{3,}"))
    near = (cued["doc_id"] == titles["doc_id"]) & F.contains(titles["title"], F.substring(cued["line"], 1, 30))
    return cued.join(titles, near, "left_anti").select("doc_id", "pos")
