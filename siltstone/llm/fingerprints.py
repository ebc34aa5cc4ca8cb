"""Bottom-k sketches of shingle hashes.

A text's sketch is the sorted array of the ``k`` smallest distinct 64-bit
hashes of its word shingles.  Sketches of parts merge to the sketch of the
whole, and two sketches estimate resemblance, containment and the number of
distinct shingles.  Everything here is a built-in DataFrame expression.

Defined results: a null text counts as empty and has the empty sketch; a text
of fewer words than a shingle has one shingle, all its words; two empty
sketches have resemblance 1, an empty and another 0; repeated rows are rows, a
null id comes before all others; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import long_array, shuffle_partitions

K = 128
SHINGLE = 5
FIRST = -(2**63)


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles: words are hashed once, a shingle hashes its words' hashes."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))

    def of(h: Column) -> Column:
        short = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= width, windows(h)).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform names the hashed words, so that they are computed once
    return F.get(F.transform(F.array(hashed), of), F.lit(0))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return bottom_k(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's bottom k that both have."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k - 1) over the k-th smallest hash's rank in [0, 1]."""
    reach = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits for each hash, smallest first."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_groups(parts: DataFrame, group: str, sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    A group with very many parts is first cut down to k hashes in each of
    ``salts`` shares, so no task sees more than its share of any group.
    """
    hashes = parts.select(F.col(group), F.explode(sketch_col).alias("_h")).distinct()
    for keys in ([group, "_salt"], [group]):
        low = Window.partitionBy(*keys).orderBy("_h")
        hashes = hashes.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts))).withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= k)
    return hashes.groupBy(group).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, in two steps of about sqrt(n)."""
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = long_array(bounds[::step]), long_array(bounds)
    block = F.size(F.filter(coarse, lambda b: b <= key))
    within = F.size(F.filter(F.slice(fine, F.greatest(F.lit(1), (block - 1) * step + 1), F.lit(step)), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + within)


def with_next(docs: DataFrame, id_col: str, carried: list[str], derived: Mapping[str, Column], buckets: int | None = None) -> DataFrame:
    """Each row with its derived columns and ``next``: a struct of the carried and derived columns of
    the row that follows in ascending id, after the last the first (one shuffle, no global sort).

    Rows go to ranges of ids, found by quantiles; the first row of each range also
    goes to the end of the range before.  Derived columns are made behind the shuffle,
    which moves the carried ones only.  Null ids come first.  Rows of one id follow one
    another by a hash of their columns; an id that fills several ranges is cut by that
    hash, so that no task holds all of its rows, but for rows equal in all columns.
    """
    spark = docs.sparkSession
    n = buckets or min(32768, 4 * shuffle_partitions(spark))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST))
    bounds = sorted(docs.select(key.alias("_k")).select(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or [])
    heavy = {k: c for k, c in sorted(Counter(bounds).items()) if c > 1}  # a key that is several bounds leaves ranges below its own empty
    rows = docs.select(id_col, *carried, key.alias("_k"), F.lit(0).cast("long").alias("_s"))
    rows = rows.withColumn("_b", (_bucket(F.col("_k"), bounds) if bounds else F.lit(0)).cast("int"))
    if heavy:
        parts = F.get(long_array(list(heavy.values())), (F.array_position(long_array(list(heavy)), F.col("_k")) - 1).cast("int"))
        rows = rows.withColumn("_c", F.coalesce(parts, F.lit(1)))
        rows = rows.withColumn("_s", F.when(F.col("_c") > 1, F.xxhash64(*carried)).otherwise(F.lit(0)))
        share = F.floor((F.col("_s").cast("double") + 2.0**63) / 2.0**64 * F.col("_c"))
        rows = rows.withColumn("_b", F.when(F.col("_c") > 1, F.col("_b") - F.col("_c") + 1 + F.least(share, F.col("_c") - 1)).otherwise(F.col("_b")).cast("int"))
    firsts = {r["_b"]: r["first"] for r in rows.groupBy("_b").agg(F.min(F.struct("_k", "_s")).alias("first")).collect()}  # at most about 2 n rows
    numbers = sorted(firsts)
    last = numbers[-1] if numbers else 0
    at = lambda values: F.get(long_array([values.get(i, 0) for i in range(last + 1)]), F.col("_b"))
    is_first = (F.col("_k") == at({b: f["_k"] for b, f in firsts.items()})) & (F.col("_s") == at({b: f["_s"] for b, f in firsts.items()}))
    before = at({b: numbers[i - 1] for i, b in enumerate(numbers)}).cast("int")
    # of rows that are first alike, only one goes to the range before: the window takes the least
    own = F.struct(F.col("_b"), F.lit(0).alias("_tail"))
    places = F.when(is_first, F.array(own, F.struct(before.alias("_b"), F.lit(1).alias("_tail")))).otherwise(F.array(own))
    rows = rows.withColumn("_p", F.explode(places)).select(id_col, *carried, "_k", "_s", F.col("_p._b").alias("_b"), F.col("_p._tail").alias("_tail"))
    rows = rows.repartition("_b").select("*", *[c.alias(name) for name, c in derived.items()])
    order = Window.partitionBy("_b").orderBy("_tail", "_k", "_s", *carried)
    every = [*carried, *derived]
    return rows.withColumn("next", F.lead(F.struct(*every)).over(order)).where("_tail = 0").select(id_col, *every, "next")


def fingerprint_documents(docs: DataFrame, *, k: int = K, width: int = SHINGLE, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text replaces the last quarter (rounded down, in code points)
    by as many leading code points of the next document's text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"], {"_sketch": sketch(F.col("text"), k, width)}, buckets)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next.text"), F.lit(1), part))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "_sketch", F.col("next._sketch").alias("_next"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_sketch", "_next", sketch(F.col("_edited"), k, width).alias("_edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_sketch")).alias("fingerprint"), as_text(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"), resemblance(F.col("_sketch"), F.col("_next"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"), containment(F.col("_sketch"), F.col("_edited_sketch"), k).alias("contained_in_edited"),
    )
