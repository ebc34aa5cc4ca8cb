"""Connected components of a link table by alternating star contractions.

The large star links each node's larger neighbours to its smallest neighbour,
the small star its smaller ones (Kiveris et al., 2014).  Both only aggregate a
minimum per node and join it back, so that no task needs a whole neighbourhood;
O(log^2) rounds end with every node linked to its component's smallest node.
Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: rows (a, b) with a < b, both stars keep that order."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
        # neighbours v > u go to the minimum
        moved = links.select(F.col("a").alias("u"), F.col("b").alias("v")).join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return moved.distinct()
    low = materialize(links.groupBy("b").agg(F.min("a").alias("m")), "star-min")
    moved = links.join(low, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(low.select(F.col("m").alias("a"), "b")).distinct()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is its component's smallest node."""
    links = links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialize(links, "links")
    seen = None
    for _ in range(most_rounds):
        links = materialize(_star(links, True), "large-star")
        links = materialize(_star(links, False), "small-star")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen or now[0] == 0:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
