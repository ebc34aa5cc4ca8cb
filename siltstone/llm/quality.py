"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Every document is reduced to a fixed vector of statistics over its whole
   text (shares of kinds of characters and words, repetition, lines).
2. Random Fourier features approximate a Gaussian kernel over the standardised
   statistics.  Each partition sums its part of the normal equations; the sums
   of partitions are added by index on the executors, so the driver receives
   one matrix per fold, whatever the number of rows or partitions.
3. Ridge scores of held-back folds are binned on a fixed grid, and pooling of
   adjacent violators makes them a calibrated, monotone probability.

The statistics are written once and reread by every step.  All labelled rows
take part in the fit; nothing but fixed-size sums reaches the driver.

Defined results: a null text is empty and scores as an empty text does; labels
that are null are left out, several labels of one id are averaged; without
labels of both kinds the score is the labels' mean, or 0.5 without any.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, small_batches

FEATURES = 192
FOLDS = 3
RIDGE = 1e-3
GRID = 2000  # bins of the ridge score between LOW and HIGH
LOW, HIGH = -1.0, 2.0
THRESHOLD = 0.7

STATISTICS = (
    "log_characters", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces", "line_breaks",
    "sentence_marks", "commas", "exclamations", "bars", "symbols", "brackets", "not_ascii", "distinct_words", "top_word",
    "same_as_before", "distinct_pairs", "upper_words", "symbol_words", "short_words", "words_in_line", "repeated_lines", "capital_words", "empty",
)

_KINDS = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("U") if 65 <= c <= 90 else ord("L") if 97 <= c <= 122 else ord("D") if 48 <= c <= 57 else ord("N") if c >= 128 else ord("n") if c == 10 else ord("s") if c in (32, 9, 11, 12, 13)
        else ord("p") if c in b".;:?" else ord("c") if c == 44 else ord("e") if c == 33 else ord("b") if c == 124 else ord("r") if c in b"()[]{}<>" else ord("q") if c in b"'\"-_" else ord("y")
        for c in range(256)
    ),
)
_ODD_WORD = re.compile(r"[#$%&*|@^~=+<>\\{}\[\]!]")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = raw.translate(_KINDS)
    n = max(len(raw), 1)
    count = kinds.count
    upper, lower, digits, other = count(b"U"), count(b"L"), count(b"D"), count(b"N")
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    sizes = [len(w) for w in words]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(sizes) / m, min(max(sizes, default=0), 100) / 100, (upper + lower + other) / n, upper / max(upper + lower, 1), digits / n, count(b"s") / n, min(count(b"n") / n, 0.2),
        count(b"p") / m, count(b"c") / m, count(b"e") / m, count(b"b") / m, count(b"y") / m, count(b"r") / m, other / n, len(counts) / m, max(counts.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, pairs / m, sum(w.isupper() and len(w) > 1 for w in words) / m, sum(bool(_ODD_WORD.search(w)) * c for w, c in counts.items()) / m, sum(s <= 3 for s in sizes) / m,
        np.log1p(m / k), 1 - len(set(lines)) / k, sum(w[0].isupper() for w in words) / m, float(not words),
    ]


def statistics_table(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``stats``, the vector as little-endian float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(statistics(t), dtype="<f4").tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], names=[*keep, "stats"])

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, stats binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<f4").reshape(-1, len(STATISTICS)).astype(np.float64)


@dataclass
class FourierMap:
    """Standardises statistics and maps them to a constant, themselves and random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = 4.0, seed: int = 8) -> FourierMap:
        rng = np.random.default_rng(seed)
        return cls(mean, scale, rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / self.waves.shape[1]) * np.cos(x @ self.waves + self.phases)
        return np.concatenate([np.ones((len(x), 1)), x, z], axis=1)


def _summed(rows: DataFrame, values: Iterator, size: int) -> np.ndarray:
    """Adds up vectors that partitions emit as (slot, part, doubles): fixed-size partial sums, added by index on the executors."""
    added = rows.mapInArrow(values, "slot int, part array<double>")
    columns = [F.sum(F.get("part", F.lit(i))) for i in range(size)] if size <= 64 else None
    if columns:
        got = {r[0]: np.array(r[1:]) for r in added.groupBy("slot").agg(*columns).collect()}
    else:
        flat = added.select("slot", F.posexplode("part").alias("i", "v")).groupBy("slot", "i").agg(F.sum("v").alias("v")).toPandas()
        got = {}
        for slot, part in flat.groupby("slot"):
            got[slot] = np.zeros(size)
            got[slot][part["i"]] = part["v"]
    return got


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the statistics over all rows."""
    k = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k + 1)
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["slot", "part"])

    total = _summed(rows.select("stats"), run, 2 * k + 1).get(0, np.zeros(2 * k + 1))
    n = max(total[0], 1)
    mean = total[1 : k + 1] / n
    return mean, np.sqrt(np.maximum(total[k + 1 :] / n - mean**2, 1e-6))


def normal_equations(rows: DataFrame, fourier: FourierMap) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per fold: Z'Z, Z'y and the row count, over (stats, label, fold) rows.

    A partition emits the upper triangle and the right-hand side per fold.
    """
    size = 1 + len(STATISTICS) + fourier.waves.shape[1]
    upper = np.triu_indices(size)
    shared = rows.sparkSession.sparkContext.broadcast(fourier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = shared.value(_matrix(batch.column(0)))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                a, b = z[folds == fold], y[folds == fold]
                part = np.concatenate([(a.T @ a)[upper], a.T @ b, [len(a)]])
                sums[int(fold)] = sums[int(fold)] + part if int(fold) in sums else part
        for fold, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], names=["slot", "part"])

    found = {}
    for fold, total in _summed(rows.select("stats", "label", "fold"), run, len(upper[0]) + size + 1).items():
        square = np.zeros((size, size))
        square[upper] = total[: len(upper[0])]
        found[fold] = (square + np.triu(square, 1).T, total[len(upper[0]) : -1], total[-1])
    return found


def solve(parts: list[tuple[np.ndarray, np.ndarray, float]], ridge: float = RIDGE) -> np.ndarray:
    square, right = sum(p[0] for p in parts), sum(p[1] for p in parts)
    penalty = np.full(len(right), ridge * max(sum(p[2] for p in parts), 1))
    penalty[0] = 1e-9  # the constant goes free
    return np.linalg.solve(square + np.diag(penalty), right)


def isotonic(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Monotone rates of binned scores by pooling adjacent violators; empty bins take what stands before."""
    blocks: list[list[float]] = []  # positives, count, bins
    for n, p in zip(counts, positives, strict=True):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][1] and (not blocks[-1][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            p1, n1, b1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p1, blocks[-1][1] + n1, blocks[-1][2] + b1]
    rates, known = [], None
    for p, n, bins in blocks:
        known = p / n if n else known
        rates += [known] * int(bins)
    first = next((r for r in rates if r is not None), 0.5)
    return np.array([first if r is None else r for r in rates])


@dataclass
class QualityModel:
    fourier: FourierMap
    weights: np.ndarray  # a column for each fold's complement, then one for all rows
    rates: np.ndarray | None = None

    def ridge(self, stats: np.ndarray, column: int = -1) -> np.ndarray:
        return self.fourier(stats) @ self.weights[:, column]

    def probability(self, stats: np.ndarray) -> np.ndarray:
        if self.rates is None:
            return np.full(len(stats), 0.5)
        at = np.clip((self.ridge(stats) - LOW) / (HIGH - LOW) * GRID - 0.5, 0, GRID - 1)
        return np.clip(np.interp(at, np.arange(GRID), self.rates), 0, 1)


def train(rows: DataFrame) -> QualityModel:
    """rows: stats, label (0 to 1), fold (0 to FOLDS - 1)."""
    spark = rows.sparkSession
    mean, scale = moments(rows)
    fourier = FourierMap.draw(mean, scale)
    parts = normal_equations(rows, fourier)
    if not parts:
        return QualityModel(fourier, np.zeros((1 + len(mean) + FEATURES, 1)))
    folds = sorted(parts)
    if len(folds) > 1:
        others = [solve([parts[g] for g in folds if g != f]) for f in folds]
    else:
        others = [solve(list(parts.values()))]
    model = QualityModel(fourier, np.stack([*others, solve(list(parts.values()))], axis=1))
    shared = spark.sparkContext.broadcast((model, {f: i for i, f in enumerate(folds)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, column = shared.value
        for batch in batches:
            stats, fold = _matrix(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            scores = fitted.fourier(stats) @ fitted.weights
            own = scores[np.arange(len(stats)), [column[f] for f in fold]]
            bins = np.clip((own - LOW) / (HIGH - LOW) * GRID, 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "label"])

    binned = rows.select("stats", "label", "fold").mapInArrow(run, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()  # at most GRID rows
    counts, positives = np.zeros(GRID), np.zeros(GRID)
    for r in binned:
        counts[r["bin"]], positives[r["bin"]] = r["n"], r["p"]
    model.rates = isotonic(counts, positives)
    return model


def labels_by_id(labels: DataFrame, column: str) -> DataFrame:
    """One (doc_id, label) row per labelled id."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(column).cast("double")).alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every document with ``score``, the calibrated probability of quality 1.

    ``learn`` (over doc_id) tells which rows' labels may be used.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    described = materialize(statistics_table(docs, ["doc_id"]), "quality-statistics")
    fold = F.pmod(F.xxhash64(F.lit("quality fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = described.select("doc_id", "stats").where(learn).join(labels_by_id(labels, "quality"), "doc_id").select("stats", "label", fold)
    model = train(materialize(rows, "quality-rows"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.probability(_matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*keep, "score"])

    # further columns, such as texts, are not written along: their rows are described once more
    rows = described if keep == ["doc_id"] else statistics_table(docs, keep)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return rows.mapInArrow(run, f"{schema}, score double")
