"""Exact top-k inner-product search as a Voronoi kNN join.

1. Pivots (a bounded sample by hash, about a common centre c) split queries and
   data into Voronoi cells.  q.x and q.(x - c) rank alike, so that only
   distances within the centred data enter the bounds.
2. Summaries per cell: data are counted by steps of their pivot distance, and a
   few rows of each cell are its seeds.  The k-th best score of a query among
   all seeds is a floor f under its k-th best score.  As
   q.x <= q.c + q.p + |q| d for x at distance d of pivot p, only rows with
   d >= (f - q.c - q.p) / |q| can matter to q; the least of these limits over
   the queries of a cell is the bound of that cell and p's (Lu et al., 2012).
3. Query cells become groups of up to a block of queries, neighbours together as
   long as they need much the same data; larger cells are cut by a hash of the
   id.  Only data at or above its limit goes to a group, cut by a hash into
   blocks of bounded size, so no task holds a hot cell; each pair of blocks is
   solved locally.
4. The local top k of a query's blocks are merged by (score desc, id).

Bounds carry a small slack against rounding; scores are exact integers.  Seeds
and pivots only steer what is sent: any choice of them gives the same result.

Defined results: vectors that are null, or hold null or non-finite components,
take no part; shorter vectors are padded with zeros; repeated rows are
candidates of their own, a repeated query row asks once; vectors of one query id
share its k best scores; a row with a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import materialize

PIVOTS = 64
SEEDS = 64  # rows of each cell that floors are taken from, about
QUERY_BLOCK = 16384
DATA_BLOCK = 16384
LEAST_BLOCKS = 16  # data blocks of a group, if it needs that many thousand rows
STEPS = 64  # of the pivot distance, in counts
SCALE = 64
SLACK = 1e-9
EXACT = 2.0**52


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x array<double>): floor(scale * component) of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return table.where(usable).where(finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    mask = np.arange(width)[None, :] < sizes[:, None]
    out[mask] = values
    return out


@dataclass
class Space:
    """The centre and the pivots around it."""

    width: int
    centre: np.ndarray  # (width,)
    pivots: np.ndarray  # (pivots, width), centred

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot)."""
        y = x - self.centre
        square = (self.pivots**2).sum(axis=1)[None, :] - 2 * y @ self.pivots.T
        cell = square.argmin(axis=1)
        return cell, np.sqrt(((y - self.pivots[cell]) ** 2).sum(axis=1))


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> Space | None:
    """Width over all rows; centre and pivots from about ``4 * count`` rows by hash of the id."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    share = min(1.0, 4 * count / n)
    sample = vectors.where(F.pmod(F.xxhash64(F.lit("pivots"), "id"), F.lit(1 << 30)) / (1 << 30) <= share).select("x").limit(16 * count).toArrow()
    x = np.unique(_rows(sample["x"].combine_chunks(), width) if sample.num_rows else np.zeros((1, width)), axis=0)
    centred = x - x.mean(axis=0)
    # farthest first, from the one nearest to the mean
    chosen = [int((centred**2).sum(axis=1).argmin())]
    reach = ((centred - centred[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(centred)):
        chosen.append(int(reach.argmax()))
        reach = np.minimum(reach, ((centred - centred[chosen[-1]]) ** 2).sum(axis=1))
    return Space(width, x.mean(axis=0), centred[chosen])


def assign(vectors: DataFrame, space: Space) -> DataFrame:
    """(id, x, cell, distance, row); ``row`` tells repeated rows apart once the result is written."""
    shared = vectors.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = shared.value.nearest(_rows(batch.column(1), shared.value.width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(distance)], names=["id", "x", "cell", "distance"])

    return vectors.select("id", "x").mapInArrow(run, "id long, x array<double>, cell int, distance double").withColumn("row", F.monotonically_increasing_id())


@dataclass
class Summary:
    """Fixed-size facts about the data: rows by (cell, distance step), the width of a step, and the seeds."""

    counts: np.ndarray  # (cells, STEPS)
    step: float
    seed_ids: np.ndarray
    seeds: np.ndarray  # (seeds, width)

    def needed(self, limits: np.ndarray) -> int:
        """How many rows lie at or above the limits (one per cell), rounded up by a step."""
        first = np.clip(np.nan_to_num(limits / self.step, nan=0, posinf=STEPS, neginf=0), 0, STEPS).astype(int)
        return int(sum(row[at:].sum() for row, at in zip(self.counts, first, strict=True)))


def summarize(data: DataFrame, space: Space, seeds: int = SEEDS) -> Summary:
    """Counts of :func:`assign`'s rows by cell and step, and about ``seeds`` rows of each cell."""
    cells = len(space.pivots)
    step = (data.agg(F.max("distance")).first()[0] or 0.0) / STEPS * (1 + 1e-12) or 1.0
    counts = np.zeros((cells, STEPS), dtype=np.int64)
    for r in data.groupBy("cell", F.least(F.floor(F.col("distance") / step), F.lit(STEPS - 1)).alias("s")).agg(F.count("*").alias("n")).collect():
        counts[r["cell"], r["s"]] = r["n"]
    share = F.get(F.array(*[F.lit(float(seeds / max(n, 1))) for n in counts.sum(axis=1)]), F.col("cell"))
    picked = data.where(F.pmod(F.xxhash64(F.lit("seeds"), "row"), F.lit(1 << 30)) / (1 << 30) <= share)
    picked = picked.select("id", "x").limit(4 * seeds * cells).toArrow()
    return Summary(counts, step, picked["id"].to_numpy(), _rows(picked["x"].combine_chunks(), space.width) if picked.num_rows else np.zeros((0, space.width)))


def floors(q: np.ndarray, ids: np.ndarray, summary: Summary, k: int) -> np.ndarray:
    """A floor under each query's k-th best score: its k-th best among the seeds other than its own row."""
    out = np.full(len(q), -np.inf)
    for at in range(0, len(q), 1024):
        scores = q[at : at + 1024] @ summary.seeds.T
        scores[ids[at : at + 1024, None] == summary.seed_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out[at : at + 1024] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.where(np.isfinite(out), out, -np.inf)


def limits_of(q: np.ndarray, floor: np.ndarray, space: Space) -> np.ndarray:
    """Per query and data cell: the pivot distance from which a row can reach the query's floor."""
    norm = np.sqrt((q**2).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = (floor[:, None] - (q @ space.centre)[:, None] - q @ space.pivots.T) / norm[:, None]
        slack = SLACK * (1 + np.abs(floor / norm)[:, None] + np.sqrt((space.centre**2).sum()) + np.sqrt((space.pivots**2).sum(axis=1))[None, :])
        limit = limit - slack
    return np.where(np.isfinite(limit), limit, -np.inf)


def query_limits(queries: DataFrame, space: Space, summary: Summary, k: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per query cell: how many queries it has, and its least limit for each data cell."""
    shared = queries.sparkSession.sparkContext.broadcast((space, summary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, summary = shared.value
        least: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for batch in batches:
            q = _rows(batch.column(1), space.width)
            limits = limits_of(q, floors(q, batch.column(0).to_numpy(), summary, k), space)
            cells = batch.column(2).to_numpy()
            for c in np.unique(cells):
                own = limits[cells == c]
                least[int(c)] = np.minimum(least.get(int(c), np.inf), own.min(axis=0))
                count[int(c)] = count.get(int(c), 0) + len(own)
        arrays = [pa.array(list(least), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([v.tolist() for v in least.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["cell", "n", "least"])

    each = queries.select("id", "x", "cell").mapInArrow(run, "cell int, n long, least array<double>")
    low = each.select("cell", "n", F.posexplode("least")).groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.min("col").alias("least"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in low.collect():  # pivots squared rows at most
        out.setdefault(r["cell"], (r["n"], np.full(len(space.pivots), -np.inf)))[1][r["pos"]] = r["least"]
    return out


@dataclass
class Group:
    """Query cells that are solved together, in ``parts`` by a hash of the query's id."""

    cells: list[int]
    asked: int
    limits: np.ndarray
    parts: int = 1
    blocks: int = 1


def group_queries(found: dict[int, tuple[int, np.ndarray]], space: Space, summary: Summary, query_block: int, data_block: int) -> list[Group]:
    """Neighbouring query cells as groups of at most a block, unless their data differ by more than a quarter."""
    left, groups = set(found), []
    at = min(left) if left else None
    while left:
        left.remove(at)
        n, limits = found[at]
        last = groups[-1] if groups else None
        both = np.minimum(last.limits, limits) if last else limits
        if last and last.asked + n <= query_block and summary.needed(both) <= 1.25 * max(summary.needed(last.limits), summary.needed(limits)):
            last.cells.append(at)
            last.asked, last.limits = last.asked + n, both
        else:
            groups.append(Group([at], n, limits))
        if left:
            rest = sorted(left)
            at = rest[int(((space.pivots[rest] - space.pivots[at]) ** 2).sum(axis=1).argmin())]
    for g in groups:
        needs = summary.needed(g.limits)
        g.parts = max(1, -(-g.asked // query_block))
        g.blocks = max(1, -(-needs // data_block), min(LEAST_BLOCKS, needs // 1024))
    return groups


def _chooser(table: np.ndarray) -> Column:
    """The row of a small matrix that belongs to column ``cell``, as array<double>."""
    rows = ",".join("[" + ",".join("1e308" if v == np.inf else "-1e308" if v == -np.inf else repr(float(v)) for v in row) + "]" for row in table)
    return F.get(F.expr(f"from_json('[{rows}]', 'array<array<double>>')"), F.col("cell"))


def _share(salt: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "id"), parts.cast("long")).cast("int")


def local_top(width: int, k: int):
    """Solves one (query block, data block) pair."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, x = (_rows(t["x"].combine_chunks(), width) for t in (left, right))
        q_ids, x_ids = (t["id"].to_numpy() for t in (left, right))
        order = np.argsort(x_ids, kind="stable")
        x, x_ids = x[order], x_ids[order]
        exact = np.sqrt((q**2).sum(axis=1).max() * (x**2).sum(axis=1).max()) < EXACT
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, len(q), 256):
            if exact:
                scores = (q[at : at + 256] @ x.T).astype(np.int64)
            else:
                whole = np.array([[int(v) for v in row] for row in x], dtype=object)
                scores = np.array([[int(v) for v in row] for row in q[at : at + 256]], dtype=object) @ whole.T
            for i, row in enumerate(scores):
                allowed = x_ids != q_ids[at + i]
                ids, own = x_ids[allowed], row[allowed]
                if len(own) > k and exact:
                    cut = np.partition(own, len(own) - k)[len(own) - k]
                    keep = own >= cut
                    ids, own = ids[keep], own[keep]
                best = np.lexsort((ids, np.array([-s for s in own] if not exact else -own)))[:k]
                for values, v in zip(out, (np.full(len(best), q_ids[at + i]), ids[best], own[best].astype(np.int64)), strict=True):
                    values.append(v)
        return pa.table([pa.array(np.concatenate(v)) for v in out], schema=schema)

    return run


def sent_rows(data: DataFrame, groups: list[Group]) -> DataFrame:
    """(id, x, group, qb, db): each data row once for every part of a group that may need it."""
    goals = F.expr("from_json('[" + ",".join(f'{{"g":{i},"q":{g.parts},"d":{g.blocks}}}' for i, g in enumerate(groups)) + "]', 'array<struct<g:int,q:int,d:int>>')")
    reach = _chooser(np.array([g.limits for g in groups]).T)
    needed = F.filter(F.arrays_zip(goals.alias("goal"), reach.alias("limit")), lambda z: F.col("distance") >= z["limit"])
    sent = data.select("id", "x", "row", F.explode(needed).alias("z")).select("id", "x", F.col("z.goal.g").alias("group"), F.col("z.goal.q").alias("_q"), F.pmod(F.xxhash64(F.lit("data"), "row"), F.col("z.goal.d").cast("long")).cast("int").alias("db"))
    return sent.select("id", "x", "group", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("qb"), "db")


def plan_groups(data: DataFrame, queries: DataFrame, space: Space, k: int, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> list[Group]:
    summary = summarize(data, space)
    return group_queries(query_limits(queries, space, summary, k), space, summary, query_block, data_block)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of (id, x) rows: each query's k best others, ties to the smaller id.

    Of ``vectors`` only id and x are read.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    vectors = materialize(vectors.select("id", "x"), "knn-vectors")
    space = choose_pivots(vectors, pivots)
    if space is None:
        return spark.createDataFrame([], empty)
    data = materialize(assign(vectors, space), "knn-data")
    queries = data.where(is_query).dropDuplicates(["id", "x"])
    groups = plan_groups(data, queries, space, k, query_block, data_block)
    if not groups:
        return spark.createDataFrame([], empty)

    # rows of one query id stay together: a hash of the id alone
    places = np.zeros((len(space.pivots), 3))
    for i, g in enumerate(groups):
        places[g.cells] = i, g.parts, g.blocks
    own = _chooser(places)
    at = lambda i: F.get(own, F.lit(i)).cast("int")
    asking = queries.select("id", "x", at(0).alias("group"), _share("query", at(1)).alias("qb"), F.explode(F.sequence(F.lit(0), at(2) - 1)).alias("db"))

    keys = ["group", "qb", "db"]
    local = asking.groupBy(*keys).cogroup(sent_rows(data, groups).groupBy(*keys)).applyInArrow(local_top(space.width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
