"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  Two fingerprints with at most
two differing bits agree on one segment and differ in at most one bit of
another (pigeonhole), in one of the three cyclic pairs (exact, fuzzy).  A fuzzy
segment is decoded with the perfect binary Golay code (23, 12): every word is
within three bits of one code word, and a word one bit away decodes to a code
word within four bits, of which there are at most six.  So each fingerprint has
one home key per pair (exact segment, index of its own code word) and at most
six probe keys (indices of its neighbours' code words); a home-probe equi-join
on 34 bits finds every link, which the full distance then verifies.

Equal fingerprints are collapsed before, links stay a distributed table, and
components come from alternating star contractions (:mod:`.components`).

:func:`keep_one`, the pipeline's stage, takes these groups first, compares their
members' shingle sets, and lets an exact join find the pairs of alike sets whose
fingerprints differ in more bits.

Defined results: null or empty text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; a null doc_id takes part
but never names a component, unless all ids of the component are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import components
from siltstone.llm.common import brief_shuffles, delete_path, discard, materialize, new_path, scratch, small_batches

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits)
PAIRS = ((0, 1), (1, 2), (2, 0))  # (exact, fuzzy)
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
AT_ONCE = 1 << 17  # shingles whose bits are held at once


def _remainders(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def golay_errors() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2,048 remainders."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], dtype=np.int64)
    table = np.empty(2048, dtype=np.int64)
    table[_remainders(patterns)] = patterns
    return table


_ERRORS = golay_errors()


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the code word nearest to each 23-bit word."""
    return (words ^ _ERRORS[_remainders(words)]) >> 11


def neighbour_indices(words: np.ndarray) -> np.ndarray:
    """Per word, the indices of its own and its 23 neighbours' code words, sorted with repeats."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)
    return np.sort(golay_index(words[:, None] ^ flips[None, :]), axis=1)


def shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint_texts(texts: list[bytes], width: int = 3) -> np.ndarray:
    """64-bit SimHash of each text (uint64); memory in proportion to the longest text, its shingles' bits are held in pieces."""
    counts = np.zeros((len(texts), 64), dtype=np.int64)
    sizes = np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = 0
            for i, n in owners:
                counts[i] += bits[at : at + n].sum(axis=0, dtype=np.int64)
                at += n
            hashes.clear()
            owners.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = shingles(text, width)
        sizes[i] = len(parts)
        for start in range(0, len(parts), AT_ONCE):
            piece = parts[start : start + AT_ONCE]
            hashes.extend([digest(p, SEED) for p in piece])
            owners.append((i, len(piece)))
            if len(hashes) >= AT_ONCE:
                flush()
    flush()
    set_bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            fp = fingerprint_texts(texts, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64) for shift, bits in SEGMENTS]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints (uint64): home keys, shape (n, 3); probe keys and their rows, flat."""
    parts = _segments(fp)
    homes, probes, rows = [], [], []
    for scheme, (exact, fuzzy) in enumerate(PAIRS):
        base = (np.int64(scheme) << 34) | (parts[exact] << 12)
        homes.append(base | golay_index(parts[fuzzy]))
        near = neighbour_indices(parts[fuzzy])
        fresh = np.ones(near.shape, dtype=bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(fresh)
        rows.append(row)
        probes.append(base[row] | near[row, col])
    return np.stack(homes, axis=1), np.concatenate(probes), np.concatenate(rows)


def _keyed(classes: DataFrame, probe: bool) -> DataFrame:
    """(key, fp); a table number in the key's upper bits keeps tables apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            base = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 36
            homes, probes, rows = fuzzy_keys(fp.view(np.uint64))
            if not probe:
                probes, rows = homes.reshape(-1), np.repeat(np.arange(len(fp)), 3)
            yield pa.RecordBatch.from_arrays([pa.array(probes | base[rows]), pa.array(fp[rows])], names=["key", "fp"])

    return classes.select("fp", "table").mapInArrow(run, "key long, fp long")


def class_links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """(table, a, b), a < b: fingerprints of one table that differ in 1 to ``radius`` bits.

    classes: (table, fp), one row per table and distinct fingerprint.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the segments are laid out for at most two differing bits")
    home = _keyed(classes, False).select("key", F.col("fp").alias("a"))
    probe = _keyed(classes, True).select("key", F.col("fp").alias("b"))
    near = (home.key == probe.key) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    found = home.join(probe, near).select(F.shiftright(home.key, 36).cast("int").alias("table"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.distinct()


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most ``radius`` (0 to 2) bits."""
    return class_links(distinct.select("fp", F.lit(0).alias("table")), radius).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links."""
    return linked(materialize(fingerprints(docs, id_col, text_col, width), "simhash"), radius)


def linked(printed: DataFrame, radius: int = 2) -> DataFrame:
    """(id, fp, component) of a written table (id, fp)."""
    distinct = materialize(printed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = components.connected(links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "simhash-roots")
    first = materialize(named.groupBy("root").agg(F.min("first").alias("component")), "simhash-first")
    # written tables on both sides: the copies of a very common fingerprint can be split in the join
    members = materialize(named.join(first, "root").select("fp", "component"), "simhash-members")
    return printed.join(members, "fp").select("id", "fp", "component")


KEYS = 8  # min-hash pairs of the first contraction
FREQUENT = 1 << 17  # shingles that the global order knows as frequent
_MIXERS = np.random.default_rng(SEED).integers(1, 1 << 32, (3, 2 * KEYS, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def min_hash_pairs(hashes: np.ndarray) -> list[int]:
    """Each of ``KEYS`` longs is two min-hashes of a set of 32-bit hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(2 * KEYS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for any text
        mixed = (hashes[None, at : at + (1 << 14)] ^ _MIXERS[0]) * _MIXERS[1]
        mixed = (mixed ^ mixed >> np.uint32(15)) * _MIXERS[2]
        np.minimum(least, (mixed ^ mixed >> np.uint32(16)).min(axis=1), out=least)
    return least.view(np.int64).tolist()


def described(docs: DataFrame, width: int) -> DataFrame:
    """(id, text, same, fp, keys, n, shingles): digests of the text and of the normalised text, its SimHash,
    min-hash pairs, and the distinct 32-bit shingle hashes with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                same, keys, sets = [], [], []
                texts = [(text or "").encode("utf-8", "surrogatepass") for text in part.column(2).to_pylist()]
                for raw in texts:
                    same.append(hashlib.md5(b" ".join(raw.lower().split())).digest())
                    hashes = np.unique(np.array([xxhash.xxh32_intdigest(s) for s in shingles(raw, width)], dtype=np.uint32))
                    keys.append(min_hash_pairs(hashes))
                    sets.append(hashes.view(np.int32))
                sizes = [len(x) for x in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + sizes).astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32)))
                columns = [part.column(0), part.column(1), pa.array(same, pa.binary()), pa.array(fingerprint_texts(texts).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "same", "fp", "keys", "n", "shingles"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_digest(F.col("text")).alias("digest"), "text")
    return rows.mapInArrow(run, "id long, text binary, same binary, fp long, keys array<long>, n int, shingles array<int>")


def text_digest(text: Column) -> Column:
    """16 bytes of a text, none of a null one."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def needed(size: int | np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's elements any set of that likeness has at least."""
    return np.ceil(threshold * np.asarray(size) - 1e-9).astype(np.int64)


def prefixes(table: DataFrame, threshold: float) -> DataFrame:
    """(row, n, weight, fp, keys, prefix): the first n - needed(n) + 1 shingles of each set in a global order.

    The order is by hash, with frequent shingles last, by their number in an
    eighth of the rows.  Any order finds the same pairs; this one keeps lists short.
    ``weight`` is the mean of these numbers: among copies of a text, the one with
    the fewest changes of its own has the most.
    """
    counted = table.where(F.pmod(F.xxhash64("row"), F.lit(8)) == 0).select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = counted.where("n > 2").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    known, times = often["key"].to_numpy().astype(np.int32).view(np.uint32), often["n"].to_numpy().astype(np.int64)
    by_hash = np.argsort(known)
    shared = table.sparkSession.sparkContext.broadcast((known[by_hash], times[by_hash]))  # FREQUENT rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            place, often = flat.astype(np.int64), np.zeros(len(flat), dtype=np.int64)
            if len(known):
                found = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = np.where(known[found] == flat, times[found], 0)
                place |= often << 32
            owner = np.repeat(np.arange(len(n)), n)
            weight = np.bincount(owner, weights=often, minlength=len(n)) / np.maximum(n, 1)
            place = place[np.lexsort((place, owner))]
            kept = np.where(n > 0, n - needed(n, threshold) + 1, 0)
            starts = np.cumsum(n) - n
            inside = np.arange(len(place)) - starts[owner] < kept[owner]
            first = pa.array((place[inside] & 0xFFFFFFFF).astype(np.uint32).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight, pa.float64()), batch.column(3), batch.column(4), lists], names=["row", "n", "weight", "fp", "keys", "prefix"])

    small_batches(table.sparkSession)
    return table.select("row", "n", "shingles", "fp", "keys").mapInArrow(run, "row long, n int, weight double, fp long, keys array<long>, prefix array<int>")


def _contracted(first: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """(node, root): components of verified links within the groups of SimHash and Golay keys, then of min-hashes.

    Each node is compared with the weightiest of its group of fingerprints; then,
    if that left them apart, with the weightiest of each of its min-hash pairs.
    It need not find all links: it makes large groups one component, so that
    their pairs need no comparison.  The weightiest of a group of copies has the
    fewest changes of its own, hence most of the others within the likeness.
    """
    weightiest = F.max_by("row", F.struct("weight", -F.col("row")))
    printed = linked(first.select(F.col("row").alias("id"), "fp")).select(F.col("id").alias("row"), "component")
    printed = materialize(printed.join(first.select("row", "weight"), "row"), "near-printed")
    groups = printed.groupBy("component").agg(weightiest.alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = materialize(printed.join(groups, "component").where("row != a").select("a", F.col("row").alias("b")), "near-golay")
    joined = components.connected(_alike(pairs, table, threshold))
    discard(printed, pairs)
    rooted = first.select("row", "weight", "keys").join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    rooted = materialize(rooted, "near-keyed")
    keyed = rooted.select("row", "weight", "root", F.posexplode("keys").alias("at", "key"))
    groups = keyed.groupBy("at", "key").agg(weightiest.alias("a"), F.max_by("root", F.struct("weight", -F.col("row"))).alias("root_a"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").drop("lo", "hi")
    pairs = materialize(keyed.join(groups, ["at", "key"]).where("root != root_a").select("a", F.col("row").alias("b")).distinct(), "near-first")
    discard(rooted)
    return components.connected(joined.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(_alike(pairs, table, threshold)))


STEP = 1.025  # ratio of neighbouring size classes


def _candidates(first: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of nodes in different components that can have the likeness, by exact bounds only.

    first: the nodes' rows of :func:`prefixes`, discarded once read; nodes: (row, root).  Take the first
    element in the global order that two alike sets of x and y elements share, at
    places i and j.  All that they share lies from there on, so x - i and y - j
    are at least what they must share, t / (1 + t) (x + y): each entry of a list
    knows ``most``, the largest partner that its place allows.  The smaller set
    of a pair can allow one of its own size, which leaves it about a ninth of its
    elements; the larger one looks the smaller up by element and class of size.
    """
    lists = first.select("row", "n", F.posexplode("prefix").alias("pos", "key"))
    most = (F.floor((F.col("n") - F.col("pos")) * ((1 + threshold) / threshold) + 1e-6) - F.col("n")).cast("long")
    # three narrow columns move, once: the lists and their counts read the same shuffle
    lists = lists.select("key", "row", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(most.bitwiseAND(F.lit((1 << 32) - 1))).alias("sizes")).repartition("key")
    several = lists.groupBy("key").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select("key")
    narrow = materialize(lists.join(several.hint("merge"), "key", "left_semi"), "near-lists")
    discard(first)
    lists = narrow.join(nodes, "row").select("key", "row", "root", F.shiftright("sizes", 32).cast("int").alias("n"), F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("most"))
    rooted = materialize(lists, "near-list-roots")
    discard(narrow)
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    lists = materialize(rooted.join(several, "key", "left_semi"), "near-list-several")
    discard(rooted)
    # most of a long list is one component, and no pair inside it is wanted: its entries meet only the others
    owner = lists.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("owner"))
    sides = materialize(lists.join(owner, "key").withColumn("inside", F.col("root") == F.col("owner")).drop("owner"), "near-list-sides")
    discard(lists)
    lists = sides
    size_class = lambda n: F.floor(F.log(n.cast("double")) / math.log(STEP)).cast("int")
    smaller = lists.where("most >= n").select("key", size_class(F.col("n")).alias("class"), F.when(F.col("inside"), 1).otherwise(2).alias("side"), F.col("row").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x"), F.col("most").alias("most_x"))
    low, high = F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-6)), F.least("n", "most")
    larger = lists.where(low <= high).select("key", F.explode(F.sequence(size_class(low), size_class(high))).alias("class"), "inside", F.col("row").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.col("most").alias("most_y"))
    larger = larger.withColumn("side", F.explode(F.when(F.col("inside"), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2))))).drop("inside")
    fits = F.expr("root_x != root_y AND n_x <= n_y AND n_y <= most_x AND n_x <= most_y")
    met = smaller.join(larger, ["key", "class", "side"]).where(fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified_near_duplicates(docs: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, text, first): near duplicates by shingle-set likeness, all of them.

    Two documents are near duplicates if their sets of ``width``-word shingles
    have a Jaccard likeness of at least ``threshold``; groups are the components
    of these links.  Equal normalised texts are one node from the start.  Links
    that SimHash with Golay keys and then min-hashes find join most of a group;
    an exact prefix-filter join then gives all other pairs that the bounds allow, each verified with whole sets.
    A row is known by id and digest of its text; ``first`` (id, text) is the
    least of the group.  Rows with a null id take no part.

    Shingles are compared as 32-bit hashes.
    """
    spark, whole = docs.sparkSession, new_path(docs.sparkSession, "near-described")
    rows = described(docs.where(F.col("doc_id").isNotNull()), width).withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(whole)
    table = spark.read.parquet(whole)
    copies = materialize(table.groupBy("same").agg(F.min("row").alias("node")), "near-copies")
    own = materialize(table.select("row", "id", "text", "same").join(copies, "same").select("row", "id", "text", "node"), "near-own")
    heads = copies.select(F.col("node").alias("row"))
    first = materialize(prefixes(table, threshold).join(heads, "row", "left_semi"), "near-prefixes")
    roots = _contracted(first, table, threshold)
    nodes = heads.join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("root", "row").alias("root"))
    nodes = materialize(nodes, "near-nodes")
    pairs = materialize(_candidates(first, nodes, threshold), "near-pairs")
    rest = _alike(pairs, table, threshold)
    delete_path(spark, whole)  # the largest of the tables; nothing reads it from here on
    roots = components.connected(nodes.select(F.col("root").alias("a"), F.col("row").alias("b")).unionAll(rest))
    named = own.join(roots, "node", "left").select("id", "text", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "near-named")
    least = materialize(named.groupBy("root").agg(F.min(F.struct("id", "text")).alias("first")), "near-least")
    return materialize(named.join(least, "root").select("id", "text", "first"), "near-found")


#: Rows up to which the ids of compared sets are broadcast (8 bytes each); beyond, both sides are merged.
BROADCAST_ROWS = 4_000_000


def _alike(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of rows whose shingle sets have at least that Jaccard likeness; pairs: a written table."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    nodes = F.broadcast(nodes) if 2 * pairs.count() <= BROADCAST_ROWS else nodes.hint("merge")
    sets = materialize(table.select("row", "shingles").join(nodes, "row", "left_semi"), "near-sets")
    at = lambda c, name: sets.select(F.col("row").alias(c), F.col("shingles").alias(name))
    common = F.size(F.array_intersect("x", "y"))
    counted = pairs.join(at("b", "y"), "b").join(at("a", "x"), "a").select("a", "b", common.alias("c"), (F.size("x") + F.size("y") - common).alias("u"))
    found = materialize(counted.where(F.col("c") >= threshold * F.col("u") - 1e-9).select("a", "b"), "near-alike")
    discard(sets)
    return found


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Documents without near duplicates of a smaller id; rows with a null id stay.

    A row is known by id and digest of its text, so that rows of one id are judged
    each by its own text; of rows equal in both, the first by their other columns stays.
    """
    spark = docs.sparkSession
    gone = new_path(spark, "near-removed")
    with scratch(), brief_shuffles(spark):
        found = verified_near_duplicates(docs, **options)
        found.where((F.col("first.id") != F.col("id")) | (F.col("first.text") != F.col("text"))).select("id", "text").distinct().write.parquet(gone)
        repeated = found.groupBy("id", "text").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    removed = spark.read.schema("id long, text binary").parquet(gone).select("id", F.col("text").alias("digest"))
    # merged at any size: the ids grow with the corpus, so they are never broadcast
    same = (docs["doc_id"].cast("long") == removed["id"]) & (text_digest(docs["text"]) == removed["digest"])
    kept = docs.join(removed.hint("merge"), same, "left_anti")
    if not repeated:
        return kept
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]))
    tie = F.row_number().over(Window.partitionBy("doc_id", text_digest(F.col("text"))).orderBy(others))
    known = kept.where(F.col("doc_id").isNotNull()).withColumn("_tie", tie).where("_tie = 1").drop("_tie")
    return known.unionAll(kept.where(F.col("doc_id").isNull()))
