"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siltstone.llm import license_scan, mixing

WEIGHTS = (5, 2, 1)


def mixing_sql(seed: int = 7, max_repeat: int = 3) -> str:
    weight = "CASE rk % 3 " + " ".join(f"WHEN {i} THEN {w}.0::DOUBLE" for i, w in enumerate(WEIGHTS)) + " END"
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS size,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk FROM s),
w AS (SELECT *, {weight} AS w, source_size::DOUBLE * {max_repeat} AS cap FROM r),
c AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= w * (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM w),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE
        (sum(source_size::DOUBLE) OVER () - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
        / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) * w END AS target FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM e"""


def license_sql(threshold: float = 0.8, stretch: float = 1.5) -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    split = f"regexp_split_to_array(translate(%s, '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.SEPARATOR}')"
    parts = [(label, license_scan.template_words(text)) for label, text in license_scan.TEMPLATES]
    templates = ", ".join(f"({i}, '{label}', {quoted(sorted(set(ws)))}, {len(ws)})" for i, (label, ws) in enumerate(parts))
    phrases = ", ".join(f"('{label}', {quoted(phrase.split(' '))})" for phrase, label in license_scan.PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
             list_filter({split % "coalesce(text, '')"}, lambda x: x <> '') AS ws FROM documents),
t(id, label, ws, size) AS (VALUES {templates}),
b(label, ws) AS (VALUES {phrases}),
need AS (SELECT id, label, len(ws) AS s, ceil({threshold} * len(ws) - 1e-9) AS need, ceil({stretch} * size - 1e-9) AS width FROM t),
tw AS (SELECT id, unnest(ws) AS w FROM t),
dw AS (SELECT n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
occ AS (SELECT n, id, w, p FROM dw JOIN tw USING (w)),
able AS (SELECT n, id, any_value(label) AS label, any_value(s) AS s, any_value(need) AS need, any_value(width) AS width
         FROM occ JOIN need USING (id) GROUP BY n, id HAVING count(DISTINCT w) >= any_value(need)),
blocks AS (SELECT n, id, a.p, any_value(label) AS label, any_value(s) AS s, any_value(need) AS need, count(DISTINCT z.w) AS c
           FROM able JOIN occ a USING (n, id) JOIN occ z USING (n, id) WHERE z.p >= a.p AND z.p < a.p + width GROUP BY n, id, a.p),
hits AS (SELECT n, label, c / s AS c FROM blocks WHERE c >= need),
places AS (SELECT n, label, unnest(list_filter(range(len(d.ws)), lambda i: d.ws[i + 1 : i + len(b.ws)] = b.ws)) AS pl
           FROM d, b),
base AS (SELECT n, count(*) AS n_base, min(pl) AS first_word, max(pl) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY n),
every AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM
           (SELECT n, label FROM hits UNION SELECT n, label FROM places) GROUP BY n),
top AS (SELECT n, max(c) AS c FROM hits GROUP BY n)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (n) LEFT JOIN every USING (n) LEFT JOIN top USING (n)"""


def warc_sql() -> str:
    # base32 of a SHA-1: 5 hexadecimal digits are 4 characters of 5 bits
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = "0123456789abcdef"
    chars = []
    for group in range(8):
        value = " + ".join(f"(strpos('{digits}', substr(h, {5 * group + i + 1}, 1)) - 1) * {16 ** (4 - i)}" for i in range(5))
        chars += [f"substr('{letters}', ((({value}) >> {5 * (3 - j)}) & 31)::INTEGER + 1, 1)" for j in range(4)]
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {" || ".join(chars)} AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def knn_sql(k: int = 20, scale: int = 64) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


ORACLES: dict[str, str] = {
    "op1_warc_zip": warc_sql(),
    "op3_voronoi_knn": knn_sql(),
    "op6_license_scans": license_sql(),
    "op7_source_mixing": mixing_sql(),
}
