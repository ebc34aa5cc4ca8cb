"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the documents are
range-sorted by that key: the key's leading bits choose one of ``n`` ranges,
ranges are summed, an exclusive prefix sum over the (few) range totals gives
each range its offset, and a second prefix sum inside the range gives each
document its exact interval of the source's shuffled word stream.  The source's
budget is then cut at its exact word: whole epochs first, the rest from the
start of the stream, the straddling document in part.

Only built-in DataFrame functions are used.  No task holds a whole source: a
source with a third of all rows is spread over its key ranges.

Defined results: null text has size 0; a null source is a source of its own,
sorted last; a null id is hashed as its own value; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, spread

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """Target words for rows of (source, source_size): water-filling in closed form.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Sorted
    by cap over weight, a source is capped exactly if its proportional share of
    what the capped ones before it leave would pass ``max_repeat`` times its
    size; the others share the rest by weight.  One row per source, so the
    window over all sources is small by nature.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1)
    turn = F.col("_rank") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    ranked = ranked.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size").cast("double") * max_repeat)
    order = everything.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_capped", F.col("_cap") * F.sum("_w").over(ahead) <= F.col("_w") * left)
    free_words = F.sum(F.col("source_size").cast("double")).over(everything) - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everything)
    free_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_w"))).over(everything)
    ranked = ranked.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(free_words / F.nullif(free_weight, F.lit(0.0)) * F.col("_w")))
    return ranked.select("source", "source_size", "target")


def _keyed(sized: DataFrame, seed: int, carry: Sequence[str]) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return sized.select("doc_id", "source", "size", key.alias("_key"), *(c for c in carry if c not in ("doc_id", "source", "size")))


def mix_sources(sized: DataFrame, *, weights: Sequence[int] = (5, 2, 1), max_repeat: int = 3, seed: int = 7, rows_per_range: int = 256, most_ranges: int = 65536, carry: Sequence[str] = ()) -> DataFrame:
    """How many words of each document the mix takes.

    ``sized`` has doc_id, source, size and the columns to carry along; the
    result adds source_size, target and taken.  Reruns agree: keys are hashes
    of seed and id.
    """
    narrow = materialize(_keyed(sized, seed, ()), "mix-keys")
    ranges = spread(narrow.count(), rows_per_range, most_ranges)
    leading = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    at = F.floor(leading * ranges / F.lit(2.0**32)).cast("int")
    same_source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null, and no source's own name
    narrow = narrow.withColumn("_range", at).withColumn("_s", same_source)

    totals = materialize(narrow.groupBy("_s", "source", "_range").agg(F.sum("size").alias("_words")), "mix-ranges")
    targets = source_targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, max_repeat)
    earlier = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_s", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets.select(same_source.alias("_s"), "source_size", "target"), "_s")

    rows = _keyed(sized, seed, carry).withColumn("_range", at).withColumn("_s", same_source) if carry else narrow
    inside = Window.partitionBy("_s", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # joined before the window, which then needs no exchange of its own
    placed = rows.join(offsets, ["_s", "_range"]).withColumn("_end", F.sum("size").over(inside))
    start = F.col("_offset") + F.col("_end") - F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    carried = [c for c in carry if c not in ("doc_id", "source", "size")]
    return placed.select("doc_id", "source", "size", *carried, "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, carry: Sequence[str] = (), **options) -> DataFrame:
    """:func:`mix_sources` over a table with doc_id, text and source."""
    extra = [c for c in carry if c not in ("doc_id", "source")]
    return mix_sources(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra), carry=extra, **options)


def mixed_corpus(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the input's columns: each document once per
    whole epoch, and a leading slice of its words where the budget cuts it.

    Documents of no words take no part; ``n_chars``, if there, follows a cut.
    """
    row = F.struct(*docs.columns).alias("_row")  # keeps columns apart that have the names used here
    mixed = mix_documents(docs.select("doc_id", "text", "source", row), carry=["_row"], **options)
    size = F.col("size")
    whole = F.floor(F.col("taken") / size).cast("int")
    part = F.col("taken") - whole * size
    epochs = F.concat(F.array_repeat(size, whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    mixed = mixed.where("taken > 0").withColumn("_words", F.explode(epochs))
    text = F.col("_row.text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    cut = F.col("_words") < size
    mixed = mixed.withColumn("_text", F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " ")).otherwise(text))
    kept = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    kept["text"] = F.col("_text")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return mixed.select(*[column.alias(name) for name, column in kept.items()])
