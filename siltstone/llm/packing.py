"""Best-fit packing of tokenised documents into fixed-length sequences.

Only piece lengths decide a packing, and there are at most ``capacity`` of
them.  So the corpus is reduced to a histogram of lengths (a table of at most
2,048 rows at any input size); the driver packs the histogram:

1. *Large items* (over a third of the capacity, so at most two in a sequence)
   are matched greedily, the largest with the largest that still fits it.
2. *Small items*, longest first, go to the tightest gap that takes them, and
   open new sequences only when there is none.

Equal lengths are moved in bulk: a *group* is a run of sequences with equal
contents, so the work and the plan depend on the capacity and not on the
number of documents.  The plan is a table of slots (length, first rank, items,
...).  Each piece is ranked among those of its length by a distributed prefix
sum, and finds sequence and offset by binary search in the slots.

Defined results: null text is empty and packs as its end token alone; repeated
rows are pieces of their own; an empty table gives no sequences.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, small_batches, spread

CAPACITY = 2048

#: Letters that every Unicode version of the two libraries classes alike; other
#: texts, and those that spell out the special token, take the slower library.
ALIKE = re.compile("[^\x00-ɏЀ-ҁҊ-ӿ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]")


class Encoder:
    """Token ids as ``tokenizers`` gives them, by way of ``tiktoken`` where that is exact."""

    _loaded: dict[tuple[str, str | None], Encoder] = {}

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def load(cls, path: str, ranks_path: str | None) -> Encoder:
        """One per Python worker."""
        if (path, ranks_path) not in cls._loaded:
            cls._loaded[path, ranks_path] = cls(path, ranks_path)
        return cls._loaded[path, ranks_path]

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not ALIKE.search(text) and not any(s in text for s in self.special):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first that may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def tokenize(docs: DataFrame, path: str, ranks_path: str | None = None, *, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids are little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.load(path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(6)]
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        for values, v in zip(out, (i, piece, start, length, zlib.crc32(raw), raw), strict=True):
                            values.append(v)
                columns = [part.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


@dataclass
class Group:
    """``many`` sequences with equal contents; a slot is (length, first rank, items in each)."""

    many: int
    gap: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> Group:
        """Take the first n sequences off, with the items that are theirs."""
        taken = Group(n, self.gap, list(self.slots))
        self.slots = [(length, first + n * each, each) for length, first, each in self.slots]
        self.many -= n
        return taken

    def add(self, length: int, first: int, each: int) -> None:
        self.slots.append((length, first, each))
        self.gap -= length * each


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that take every item; work is bounded by the capacity."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]
        return first

    done: list[Group] = []
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if a not in left:
            large.pop()
            continue
        partners = [b for b in large[: bisect_left(large, capacity - a + 1)] if b in left]
        if not partners:
            n = left[a]
            group = Group(n, capacity)
            group.add(a, take(a, n), 1)
        elif partners[-1] == a:
            n = left[a] // 2
            if not n:  # a single one: its partner is the next shorter
                n, group = 1, Group(1, capacity)
                group.add(a, take(a, 1), 1)
                if len(partners) > 1:
                    group.add(partners[-2], take(partners[-2], 1), 1)
            else:
                group = Group(n, capacity)
                group.add(a, take(a, 2 * n), 2)
        else:
            b = partners[-1]
            n = min(left[a], left[b])
            group = Group(n, capacity)
            group.add(a, take(a, n), 1)
            group.add(b, take(b, n), 1)
        done.append(group)

    gaps: dict[int, list[Group]] = {}
    order: list[int] = []

    def keep(group: Group) -> None:
        if group.gap not in gaps:
            gaps[group.gap] = []
            insort(order, group.gap)
        gaps[group.gap].append(group)

    for group in done:
        keep(group)
    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                group = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                group = Group(-(-left[length] // (capacity // length)), capacity)
            each, n = group.gap // length, left[length]
            if n < group.many * each:
                full, odd = divmod(n, each)
                if full:
                    part = group.split(full)
                    part.add(length, take(length, full * each), each)
                    keep(part)
                if odd:
                    part = group.split(1)
                    part.add(length, take(length, odd), odd)
                    keep(part)
                if group.many:
                    keep(group)
            else:
                group.add(length, take(length, group.many * each), each)
                keep(group)
    return [g for groups in gaps.values() for g in groups]


def slot_table(groups: list[Group]) -> dict[str, np.ndarray]:
    """Slots sorted by (length, first rank), with each group's first sequence and the slot's offset."""
    rows, base = [], 0
    for group in groups:
        offset = 0
        for length, first, each in group.slots:
            rows.append((length, first, each, base, offset))
            offset += length * each
        base += group.many
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


def place(ranked: DataFrame, slots: dict[str, np.ndarray]) -> DataFrame:
    """Adds sequence_id and offset to rows with length and rank; slots are few at any size."""
    names = ranked.columns
    at = {name: names.index(name) for name in ("length", "rank")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.stack([slots["length"], slots["first"]], axis=1)
        order = np.array([(int(a) << 48) | int(b) for a, b in keys], dtype=np.int64)
        for batch in batches:
            length, rank = (batch.column(at[x]).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            k = np.searchsorted(order, (length << 48) | rank, side="right") - 1
            within = rank - slots["first"][k]
            each = slots["each"][k]
            sequence = slots["sequence"][k] + within // each
            offset = slots["offset"][k] + within % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def rank_by_length(pieces: DataFrame, rows_per_range: int = 256) -> DataFrame:
    """Adds ``rank``, from 0 among pieces of equal length, by a distributed prefix sum."""
    ranges = spread(pieces.count(), rows_per_range, 65536)
    pieces = pieces.withColumn("_r", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(ranges)).cast("int"))
    totals = materialize(pieces.groupBy("length", "_r").agg(F.count("*").alias("_n")), "pack-ranges")
    earlier = Window.partitionBy("length").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("length", "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_r").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_i", F.row_number().over(inside)).join(offsets, ["length", "_r"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_i") - 1).drop("_r", "_i", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece (a written table of doc_id, piece, start, length, ids_crc32)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    return place(rank_by_length(pieces), slot_table(pack_histogram(counts, capacity))).drop("rank")


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, *, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenises once (the pieces are written to the shared folder) and packs."""
    pieces = materialize(tokenize(docs, path, ranks_path, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the concatenated ids, at most ``capacity`` of them in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
