"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. *Evidence.*  A lexicon of insults, and affixes and words that the labelled
   rows, all of them, show to go with toxic texts, are looked up in every
   document; patterns (address in the second person, shouting, exclamation
   marks) are measured.  One pass over whole texts writes a narrow table.
2. *Voters.*  Each lexicon group, each share of the induced terms and each
   pattern votes toxic, clean or abstains.
3. *Label model.*  Votes of all learnable rows, labelled or not, are counted
   by vote vector (at most 3^voters rows, in practice hundreds).  Given the
   class, a vote depends on the vote of one other voter: the tree of strongest
   dependencies (Chow and Liu, 1968), estimated with the class prior and all
   accuracies by EM.  No label enters it.
4. *Classifier.*  All learnable rows train a logistic regression over the
   evidence on the label model's posteriors.  Given labels only place the
   threshold: odds are shifted so that 0.5 parts all labelled rows best.

No count, model or threshold comes from a sample.  Tables of more than
``driver_rows`` distinct rows stay distributed: tasks sum the classifier's loss
and gradient, and prefix sums over ranges of odds place the threshold.

Labels are used to induce terms and to place the threshold.

Defined results: a null text is empty; null labels are left out; texts without
evidence get the classifier's base score; without labels the lexicon and the
patterns alone vote and the threshold is the classifier's own; repeated rows
each get their own score; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize, small_batches
from siltstone.llm.quality import labels_by_id

#: Insults by theme; a voter for each theme.
LEXICON: dict[str, tuple[str, ...]] = {
    "mind": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "dumb", "imbecile", "halfwit", "dimwit", "retard", "brainless"),
    "worth": ("loser", "losers", "pathetic", "worthless", "clown", "clowns", "useless", "nobody", "failure", "joke"),
    "disgust": ("scum", "trash", "disgusting", "garbage", "filth", "filthy", "vermin", "vile", "repulsive", "revolting"),
    "abuse": ("bastard", "bastards", "bitch", "whore", "slut", "asshole", "damn", "fuck", "fucking", "shit", "crap", "freak", "pig", "pigs"),
    "german": ("dummkopf", "arschloch", "trottel", "vollidiot", "abschaum", "scheiße", "wertlos", "versager"),
    "french": ("connard", "salaud", "imbécile", "crétin", "ordure", "merde", "raclure", "minable"),
    "spanish": ("estúpido", "imbécil", "idiota", "basura", "mierda", "escoria", "cabrón", "inútil"),
}
INDUCED_VOTERS = 12
PATTERNS = ("address", "shouting", "exclaiming")
AFFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3)  # a term counts as evidence again when it occurs twice, and three times

#: Parameters of :func:`score_toxicity`.
MOST_TERMS = 4096  # terms that the classifier knows
DRIVER_ROWS = 20_000  # distinct rows up to which the driver computes what tasks do beyond, with the same result

#: Labelled rows up to which their ids are broadcast; beyond, both sides are merged.
BROADCAST_ROWS = 4_000_000

_WORDS = re.compile(r"[^\W\d_]+")
_ADDRESS = re.compile(r"\b(?:you|your|du|tu|vous|usted)\W+(?:are|re|bist|es|êtes|eres)?\W*(?:an?|ein|eine|une?|una?)?\W*([^\W\d_]+)", re.IGNORECASE)


def terms_of(word: str) -> list[str]:
    """The word itself, its prefixes and its suffixes, told apart by a mark."""
    return ["=" + word, *("^" + word[:n] for n in AFFIXES if len(word) > n), *("$" + word[-n:] for n in AFFIXES if len(word) > n)]


def document_terms(text: str | None, of: Callable[[str], Iterable[str]] = terms_of) -> set[tuple[str, int]]:
    """(term, level) for every term that occurs that often, or more, in the whole text."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORDS.findall((text or "").lower())).items():
        for term in of(word):
            counts[term] += n
    return {(t, level) for t, n in counts.items() for level in LEVELS if n >= level}


def _count_terms(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """(term, level, n): documents of (text) that have it, counted within tasks first; only of the terms ``among``, if given."""
    wanted = texts.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        cache: dict[str, tuple[str, ...]] = {}

        def of(word: str) -> tuple[str, ...]:
            hit = cache.get(word)
            if hit is None:
                if len(cache) > 500_000:
                    cache.clear()
                hit = cache[word] = tuple(t for t in terms_of(word) if t in wanted.value)
            return hit

        def emit() -> pa.RecordBatch:
            arrays = [pa.array([t for t, _ in counts], pa.string()), pa.array([level for _, level in counts], pa.int32()), pa.array(counts.values(), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["term", "level", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(document_terms(text) if wanted.value is None else document_terms(text, of))
                if len(counts) > 2_000_000:
                    yield emit()
        yield emit()

    small_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(run, "term string, level int, n long").groupBy("term", "level").agg(F.sum("n").alias("n"))


def by_id(known: DataFrame) -> DataFrame:
    """The labelled rows as a side of a join: broadcast up to ``BROADCAST_ROWS``, merged beyond."""
    return F.broadcast(known) if known.count() <= BROADCAST_ROWS else known.hint("merge")


def induce_terms(docs: DataFrame, labels: DataFrame, *, weak: float = 3.0, most_terms: int = MOST_TERMS) -> list[tuple[str, int, float]]:
    """(term, level, lift) that go with toxic labels, over all labelled rows, the ``most_terms`` that tell most.

    Toxic rows are counted first.  A term must be in 1 of 500 of them, so that at
    most 500 times as many terms as a toxic row has on the mean reach the driver;
    clean rows are counted for these alone.
    """
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy((F.col("label") >= 0.5).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return []
    known = labels.select("doc_id", (F.col("label") >= 0.5).alias("toxic"))
    texts = docs.join(by_id(known), "doc_id").select("text", "toxic")
    if n1 + n0 > BROADCAST_ROWS:
        texts = materialize(texts, "toxic-labelled")
    toxic = {(r["term"], r["level"]): r["n"] for r in _count_terms(texts.where("toxic")).where(F.col("n") >= max(3, round(0.002 * n1))).collect()}
    clean = {(r["term"], r["level"]): r["n"] for r in _count_terms(texts.where("not toxic"), {t for t, _ in toxic}).collect()}
    lifts = {key: (n / n1) / ((clean.get(key, 0) + 0.5) / n0) for key, n in toxic.items()}
    ranked = sorted((key for key, lift in lifts.items() if lift >= weak), key=lambda key: (-toxic[key] * math.log(lifts[key]), *key))
    return [(term, level, lifts[term, level]) for term, level in ranked[:most_terms]]


class Evidence:
    """What is looked for, by number: lexicon themes, patterns, then induced (term, level)s."""

    def __init__(self, terms: list[tuple[str, int, float]], strong: float = 20.0):
        self.first = len(LEXICON) + len(PATTERNS)
        self.size = self.first + len(terms)
        self.voters = self.first + INDUCED_VOTERS
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for i, (term, level, _) in enumerate(terms):
            self.levels.setdefault(term, []).append((level, self.first + i))
        self.strong = {self.first + i for i, (_, _, lift) in enumerate(terms) if lift >= strong}
        self.themes = {w: i for i, words in enumerate(LEXICON.values()) for w in words}

    def find(self, text: str | None, cache: dict[str, tuple[int | None, tuple[str, ...]]]) -> list[int]:
        """Numbers of the evidence that a whole text has, sorted."""
        text = text or ""
        found: set[int] = set()
        words = _WORDS.findall(text.lower())
        counts: Counter[str] = Counter()
        for word, n in Counter(words).items():
            hit = cache.get(word)
            if hit is None:
                hit = self.themes.get(word), tuple(t for t in terms_of(word) if t in self.levels)
                if len(cache) > 500_000:
                    cache.clear()
                cache[word] = hit
            if hit[0] is not None:
                found.add(hit[0])
            for term in hit[1]:
                counts[term] += n
        for term, n in counts.items():
            found.update(i for level, i in self.levels[term] if n >= level)
        if any(m.lower() in self.themes for m in _ADDRESS.findall(text)):
            found.add(len(LEXICON))
        upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if upper > 40 and upper > 0.4 * len(text):
            found.add(len(LEXICON) + 1)
        if len(words) > 5 and text.count("!") > 0.2 * len(words):
            found.add(len(LEXICON) + 2)
        return sorted(found)

    def votes(self, found: list[int]) -> list[int]:
        """1 toxic, -1 clean, 0 abstains, per voter.

        Lexicon and term voters that find nothing vote clean; patterns that do
        not hold abstain.  Each of the term voters has a share of the strong terms.
        """
        have = set(found)
        out = [1 if i in have else -1 for i in range(len(LEXICON))]
        out += [1 if len(LEXICON) + i in have else 0 for i in range(len(PATTERNS))]
        shares = {(i - self.first) % INDUCED_VOTERS for i in have & self.strong}
        return out + [1 if v in shares else -1 for v in range(INDUCED_VOTERS)]


def strongest_tree(strength: np.ndarray, least: float) -> list[int]:
    """Each voter's parent (-1 for none) in the forest of greatest total strength, of links above ``least``; parents come first."""
    m = len(strength)
    parent, inside, order = [-1] * m, [False] * m, []
    best, link = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        at = max((i for i in range(m) if not inside[i]), key=lambda i: (best[i], -i))
        parent[at] = int(link[at]) if best[at] > least else -1
        inside[at] = True
        order.append(at)
        closer = strength[at] > best
        best, link = np.where(closer, strength[at], best), np.where(closer, at, link)
    return parent


@dataclass
class LabelModel:
    """Class prior, P(vote | class) per voter, and P(vote | vote of its parent, class) along the tree of dependencies."""

    prior: float
    tables: np.ndarray  # (2, voters, 3): class, voter, vote + 1
    parents: list[int]
    edges: np.ndarray  # (2, voters, 3, 3): class, voter, parent's vote + 1, vote + 1
    correlations: np.ndarray  # given the class, of all pairs

    @classmethod
    def fit(cls, votes: np.ndarray, counts: np.ndarray, first: np.ndarray, rounds: int = 200, settle: int = 20) -> LabelModel:
        """votes: (patterns, voters); counts: rows of each; EM starts from ``first``, P(class 1) of each pattern.

        The tree may change in the first ``settle`` rounds and stays then.
        """
        n, m = votes.shape
        one_hot = np.eye(3)[votes + 1].reshape(n, 3 * m)
        total, q, parents = counts.sum(), first, [-1] * m
        overall = ((counts @ one_hot).reshape(m, 3) + 0.5) / (total + 1.5)
        for turn in range(rounds):
            weights = [counts * (1 - q), counts * q]
            prior = float(np.clip(weights[1].sum() / max(total, 1), 1e-6, 1 - 1e-6))
            # smoothed towards all rows' votes, so that a voter that never speaks favours no class
            tables = np.stack([(w @ one_hot).reshape(m, 3) + overall for w in weights])
            tables /= tables.sum(axis=2, keepdims=True)
            joint = np.stack([(one_hot.T * w) @ one_hot for w in weights]).reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4)  # class, i, j, vote of i, vote of j
            # smoothed towards independence given the class
            product = tables[:, :, None, :, None] * tables[:, None, :, None, :]
            smooth = (joint + product) / (joint.sum(axis=(3, 4), keepdims=True) + 1)
            if turn < settle:
                share = np.array([1 - prior, prior])[:, None, None, None, None]
                information = (share * smooth * np.log(smooth / product)).sum(axis=(0, 3, 4))
                parents = strongest_tree(information * (1 - np.eye(m)), 13 / max(total, 1))  # what chance hardly gives
            edges = np.stack([smooth[:, p, i] / smooth[:, p, i].sum(axis=2, keepdims=True) if p >= 0 else np.repeat(tables[:, i, None, :], 3, axis=1) for i, p in enumerate(parents)], axis=1)
            model = cls(prior, tables, parents, edges, np.zeros((m, m)))
            fresh = model.posterior(votes)
            if turn > settle and np.abs(fresh - q).max() < 1e-6:
                break
            q = fresh
        values = np.array([-1.0, 0.0, 1.0])
        covariance = np.zeros((m, m))
        for k, share in enumerate((1 - q, q)):
            residual = votes - tables[k] @ values
            covariance += (residual.T * (counts * share)) @ residual
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        model.correlations = covariance / np.outer(spread, spread)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        codes, at = votes + 1, np.arange(votes.shape[1])
        above = np.where(np.array(self.parents) >= 0, codes[:, self.parents], 0)  # the three rows of a voter without a parent are equal
        odds = (np.log(self.edges[1][at, above, codes]) - np.log(self.edges[0][at, above, codes])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -40, 40)))

    @property
    def accuracies(self) -> np.ndarray:
        """P(vote agrees with the class | it votes), per voter."""
        right = self.prior * self.tables[1][:, 2] + (1 - self.prior) * self.tables[0][:, 0]
        wrong = self.prior * self.tables[1][:, 0] + (1 - self.prior) * self.tables[0][:, 2]
        return right / (right + wrong)


def majority(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A soft majority in which voters that repeat one another count as one: a start for EM without knowledge of the voters."""
    centred = votes - (counts @ votes) / counts.sum()
    cross = (centred.T * counts) @ centred
    scale = np.sqrt(np.maximum(np.diag(cross), 1e-9))
    m = votes.shape[1]
    alike = np.maximum(cross / np.outer(scale, scale), 0) ** 4 * (1 - np.eye(m)) + np.eye(m)
    return 1 / (1 + np.exp(-votes @ (2 / alike.sum(axis=1))))


def loss_and_gradient(rows: pa.RecordBatch | pa.Table, w: np.ndarray) -> np.ndarray:
    """The logistic loss of (found, n, posterior) on soft labels, then its gradient; sums over rows."""
    found, n, y = (rows.column(i).combine_chunks() if isinstance(rows, pa.Table) else rows.column(i) for i in range(3))
    n, y = n.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
    columns = found.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n)), found.value_lengths().to_numpy(zero_copy_only=False))
    odds = np.bincount(owner, weights=w[columns], minlength=len(n)) + w[-1]
    miss = n * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
    slopes = np.bincount(columns, weights=miss[owner], minlength=len(w) - 1)
    return np.concatenate([[(n * (np.logaddexp(0, odds) - y * odds)).sum()], slopes, [miss.sum()]])


def summed_by_tasks(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """:func:`loss_and_gradient` over a distributed table; a row per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            total += loss_and_gradient(batch, w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return np.sum([np.frombuffer(r["total"]) for r in rows.mapInArrow(run, "total binary").collect()], axis=0)


def logistic(summed: Callable[[np.ndarray], np.ndarray], size: int, n: float, l2: float = 2e-5, rounds: int = 120, least: float = 1e-6, memory: int = 12) -> np.ndarray:
    """Weights (the last is the constant) of present evidence, by L-BFGS on the mean loss over all rows.

    summed: the sums of :func:`loss_and_gradient` at given weights; each call is one pass.
    """
    ridge = l2 * np.append(np.ones(size), 0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = summed(w) / max(n, 1)
        return sums[0] + (ridge * w * w).sum() / 2, sums[1:] + ridge * w

    w = np.zeros(size + 1)
    loss, gradient = at(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() < least:
            break
        step, shares = gradient.copy(), []
        for s, y in reversed(past):
            shares.append((s @ step) / (s @ y))
            step -= shares[-1] * y
        if past:
            step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), share in zip(past, reversed(shares), strict=True):
            step += s * (share - (y @ step) / (s @ y))
        length = 1.0
        while True:
            new = w - length * step
            new_loss, new_gradient = at(new)
            if new_loss <= loss - 1e-4 * length * (gradient @ step) or length < 1e-6:
                break
            length /= 2
        if new_loss >= loss:
            break
        if (new - w) @ (new_gradient - gradient) > 1e-12 * ((new_gradient - gradient) ** 2).sum():
            past = [*past, (new - w, new_gradient - gradient)][-memory:]
        w, loss, gradient = new, new_loss, new_gradient
    return w


def evidence_table(docs: DataFrame, evidence: Evidence, keep: list[str]) -> DataFrame:
    """The kept columns and ``found``: one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int | None, tuple[str, ...]]] = {}
        for batch in batches:
            found = [shared.value.find(t, cache) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*keep, "found"])

    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{schema}, found array<int>")


@dataclass
class ToxicityModel:
    evidence: Evidence
    labels: LabelModel
    weights: np.ndarray
    threshold: float = 0.0  # odds at which the score is 0.5

    def odds(self, found: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum() if len(f) else 0.0 for f in found]) + self.weights[-1]

    def score(self, found: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(found) - self.threshold, -30, 30)))


def best_threshold(odds: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the odds between which the F1 of the weighted rows is greatest; 0 without toxic rows."""
    if not toxic.any() or toxic.all():
        return 0.0
    order = np.argsort(-odds, kind="stable")
    values, hit, all_ = odds[order], np.cumsum((toxic * weight)[order]), np.cumsum(weight[order])
    f1 = np.where(np.append(values[1:] < values[:-1], True), 2 * hit / (all_ + (toxic * weight).sum()), -1)
    at = int(f1.argmax())
    return float(values[at] + values[at + 1]) / 2 if at + 1 < len(values) else float(values[at]) - 1.0


def best_threshold_by_ranges(counted: DataFrame) -> float:
    """:func:`best_threshold` over a distributed table (odds, toxic, n), by prefix sums over ranges of odds."""
    hit, every = F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("every")
    ranges = counted.groupBy("odds").agg(hit, every).repartitionByRange(F.desc("odds")).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "toxic-ranges")
    parts = ranges.groupBy("part").agg(F.sum("hit").alias("hit"), F.sum("every").alias("every"), F.max("odds").alias("most")).orderBy("part").collect()
    all_hit, all_rows = sum(r["hit"] for r in parts), sum(r["every"] for r in parts)
    if all_hit in (0, all_rows):
        return 0.0
    before = [(r["part"], sum(q["hit"] for q in parts[:i]), sum(q["every"] for q in parts[:i]), parts[i + 1]["most"] if i + 1 < len(parts) else None) for i, r in enumerate(parts)]
    before = counted.sparkSession.createDataFrame(before, "part int, hit_before long, every_before long, following double")
    down = Window.partitionBy("part").orderBy(F.desc("odds"))
    sums = ranges.select("part", "odds", F.sum("hit").over(down).alias("hit"), F.sum("every").over(down).alias("every"), F.lead("odds").over(down).alias("next"))
    f1 = 2 * (F.col("hit") + F.col("hit_before")) / (F.col("every") + F.col("every_before") + all_hit)
    best = sums.join(F.broadcast(before), "part").agg(F.max_by(F.struct("odds", F.coalesce("next", "following").alias("next")), F.struct(f1, F.col("odds"))).alias("best")).first()["best"]
    return best["odds"] - 1.0 if best["next"] is None else (best["odds"] + best["next"]) / 2


def train(evidence: Evidence, rows: DataFrame, labels: DataFrame | None = None, *, driver_rows: int = DRIVER_ROWS) -> ToxicityModel:
    """rows: (doc_id, found) of all rows that may be learned from; labels: (doc_id, label) of some of them, for the threshold."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(evidence)
    grouped = materialize(rows.groupBy("found").agg(F.count("*").alias("n")), "toxic-found")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = ["".join("-0+"[v + 1] for v in shared.value.votes(f)) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.string())], names=["found", "n", "votes"])

    voted = grouped.mapInArrow(vote, "found array<int>, n long, votes string").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # bounded by the voters
    size = evidence.voters
    votes = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in voted], dtype=np.int64).reshape(-1, size)
    counts = np.array([r["n"] for r in voted], dtype=np.float64)
    if not len(votes):
        votes, counts = np.full((1, size), -1), np.ones(1)
    # lexicon and term voters are rarely wrong where they fire: EM starts from that
    model = LabelModel.fit(votes, counts, np.where((votes > 0).any(axis=1), 0.8, 0.01))
    believed = context.broadcast(model)

    def believe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = np.array([shared.value.votes(f) for f in batch.column(0).to_pylist()], dtype=np.int64).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(believed.value.posterior(votes), pa.float64())], names=["found", "n", "posterior"])

    soft = materialize(grouped.mapInArrow(believe, "found array<int>, n long, posterior double"), "toxic-posteriors")
    if soft.count() <= driver_rows:
        local = soft.toArrow()
        weights = logistic(lambda w: loss_and_gradient(local, w), evidence.size, counts.sum())
    else:
        weights = logistic(lambda w: summed_by_tasks(soft, w), evidence.size, counts.sum())
    fitted = ToxicityModel(evidence, model, weights)
    if labels is not None:
        scorer = context.broadcast(fitted)

        def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(scorer.value.odds(batch.column(0).to_pylist()), pa.float64()), batch.column(1)], names=["odds", "toxic"])

        known = rows.join(by_id(labels.select("doc_id", (F.col("label") >= 0.5).alias("toxic"))), "doc_id").select("found", "toxic")
        counted = materialize(known.mapInArrow(odds, "odds double, toxic boolean").groupBy("odds", "toxic").agg(F.count("*").alias("n")), "toxic-odds")
        if counted.count() <= driver_rows:
            local = counted.toArrow()
            fitted.threshold = best_threshold(*(local[c].to_numpy() for c in ("odds", "toxic", "n")))
        else:
            fitted.threshold = best_threshold_by_ranges(counted)
    return fitted


def score_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, *, keep: list[str] | None = None, most_terms: int = MOST_TERMS, driver_rows: int = DRIVER_ROWS,
) -> DataFrame:
    """The kept columns of every document with ``score``: how likely label 1 is.

    ``learn`` (over doc_id) tells which rows' labels and texts may be learned from.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    known = materialize(labels_by_id(labels, "toxic").where(learn), "toxic-labels")
    evidence = Evidence(induce_terms(docs.select("doc_id", "text"), known, most_terms=most_terms))
    table = materialize(evidence_table(docs, evidence, keep), "toxic-evidence")
    model = train(evidence, table.where(learn).select("doc_id", "found"), known, driver_rows=driver_rows)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"`{n}` {table.schema[n].dataType.simpleString()}" for n in keep)
    return table.mapInArrow(run, f"{schema}, score double")
