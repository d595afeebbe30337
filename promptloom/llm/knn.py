"""Exact top-k search by a Voronoi join: pivots, bounds of query groups from cell summaries, replication only where they reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Pivots at most, drawn rows per pivot and passes that place them, numbers in all pivots together, and data rows of one block.
PIVOTS, DRAWN, PASSES, PIVOT_NUMBERS, BLOCK_ROWS = 1024, 8, 5, 1 << 20, 16_384
#: Scores are longs: what lies beyond them counts as the nearest one. The least long marks a row that is no candidate.
MOST, NONE = (1 << 63) - 1, -(1 << 63)
_CELL = "cell int, far double, along double, off double"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as double; null if the vector, a component or its 256-fold is null or not finite."""
    big = F.transform(vector, lambda x: x.cast("double") * 256)
    odd = F.exists(big, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(big, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def place_pivots(drawn: np.ndarray, count: int) -> np.ndarray:
    """``count`` pivots at most: means of a few assignment passes over the drawn rows, from the first distinct ones on."""
    _, first = np.unique(drawn, axis=0, return_index=True)
    pivots = drawn[np.sort(first)[:count]]
    for _ in range(PASSES):
        cell = (drawn @ pivots.T - (pivots**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, drawn)
        n = np.bincount(cell, minlength=len(pivots))[:, None]
        pivots = np.where(n > 0, sums / np.maximum(n, 1), pivots)
    return pivots


def _sides(x: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row along its pivot's direction, and the length of the rest."""
    along = (x * unit).sum(1)
    return along, np.sqrt(np.maximum(0, (x**2).sum(1) - along**2))


def _units(pivots: np.ndarray) -> np.ndarray:
    return pivots / np.maximum(np.sqrt((pivots**2).sum(1)), 1e-300)[:, None]


def _cells(pivots: np.ndarray):
    """Each row's Voronoi cell (its nearest pivot, ties to the earlier one), its distance to the pivot, and its two sides."""
    half, units = (pivots**2).sum(1) / 2, _units(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = _matrix(part.column(1), pivots.shape[1])
                cell = (x @ pivots.T - half).argmax(1)
                along, off = _sides(x, units[cell])
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(along), pa.array(off)], names=["vec_id", "v", "cell", "far", "along", "off"])

    return run


class Cells:
    """Summaries of the data cells: rows, largest distance to the pivot, range along its direction, largest length off it."""

    def __init__(self, pivots: np.ndarray, rows: list) -> None:
        self.ids = np.array([r["cell"] for r in rows])
        self.pivots = pivots[self.ids]
        self.units = _units(self.pivots)
        self.far, self.low, self.high, self.off = (np.array([r[c] for r in rows], np.float64) for c in ("far", "low", "high", "off"))
        self.parts = [-(-r["n"] // BLOCK_ROWS) for r in rows]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No row of a cell (columns) scores more with a query (rows): the better of the ball's bound and the sides' bound. NaN where neither can be said."""
        size = np.sqrt((q**2).sum(1))[:, None]
        ball = q @ self.pivots.T + size * self.far
        along = q @ self.units.T
        off = np.sqrt(np.maximum(0, size**2 - along**2))
        best = np.minimum(ball, np.maximum(along * self.low, along * self.high) + off * self.off)
        return best + 1e-9 * (1 + size * (np.sqrt((self.pivots**2).sum(1)) + self.far))

    def group_bounds(self, radii: np.ndarray) -> np.ndarray:
        """The same for any query of a group (rows: the cell whose pivot is the group's centre, within the radius)."""
        size, own = np.sqrt((self.pivots**2).sum(1)), self.pivots @ self.pivots.T
        return own + size[:, None] * self.far + radii[:, None] * (size + self.far) + 1e-9 * (1 + (size + radii)[:, None] * (size + self.far))


def _home(cells: Cells):
    """Each query's group: the cell whose pivot scores highest with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), cells.pivots.shape[1])
            at = (q @ cells.pivots.T).argmax(1)
            apart = np.sqrt(((q - cells.pivots[at]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32)), pa.array(apart)], names=["row", "query_id", "v", "g", "apart"])

    return run


def _reach(cells: Cells, allowed: np.ndarray):
    """The other cells that a query may find a partner in: those its group may reach, and of them those its own bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                q, g = _matrix(part.column(2), cells.pivots.shape[1]), part.column(3).to_numpy()
                t = np.array([-np.inf if x is None else x for x in part.column(4).to_pylist()], np.float64)
                near = allowed[g] & ~(cells.bounds(q) < t[:, None])  # NaN, where squares leave the doubles, is within reach
                near[np.arange(len(g)), g] = False
                rows, to = np.nonzero(near)
                for i in range(0, len(rows), 20_000):
                    take = pa.array(rows[i : i + 20_000])
                    yield pa.record_batch([*(part.column(c).take(take) for c in (0, 1, 2)), pa.array(to[i : i + 20_000].astype(np.int32)), part.column(4).take(take)], names=["row", "query_id", "v", "c", "least"])

    return run


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as longs; doubles do where no sum can leave their exact range, Python's integers elsewhere."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.nan_to_num(np.clip(q @ x.T, -(2.0**62), 2.0**62)).astype(np.int64)
        wide_q, wide_x = np.abs(q).max(1) >= 2**26, np.abs(x).sum(1) >= 2**27
    for i in range(len(q)) if wide_x.any() else np.flatnonzero(wide_q):
        a = [int(c) for c in q[i]]
        for j in range(len(x)) if wide_q[i] else np.flatnonzero(wide_x):
            out[i, j] = max(-MOST, min(MOST, sum(b * int(c) for b, c in zip(a, x[j], strict=True))))
    return out


def best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score): the k best distinct vec_ids of each query among rows sorted by vec_id, not below ``least``."""
    score = exact_scores(q, x)
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(starts) < len(ids):
        score, ids = np.maximum.reduceat(score, starts, axis=1), ids[starts]
    score[(q_ids[:, None] == ids[None, :]) | (score < least[:, None])] = NONE
    n = min(k, len(ids))
    edge = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n : len(ids) - n + 1]
    r, c = np.nonzero((score >= edge) & (score > NONE))
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < n
    r, c = r[keep], c[keep]
    return r, ids[c], score[r, c]


def _solve(k: int, dim: int):
    """Blocks one after another: a block's data rows are held, its queries pass by, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held = None, [], []
        ready: tuple | None = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)  # cell, block, side
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
                if b == a:
                    continue
                if tuple(keys[a, :2]) != block:
                    block, ids, held, ready = tuple(keys[a, :2]), [], [], None
                part = batch.slice(a, b - a)
                v = _matrix(part.column(6), dim)
                if keys[a, 2] == 0:
                    ids.append(part.column(4).to_numpy())
                    held.append(v)
                    continue
                if not held:
                    continue
                if ready is None:
                    every, x = np.concatenate(ids), np.concatenate(held)
                    order = np.argsort(every, kind="stable")
                    ready = (every[order], x[order])
                rows, q_ids = part.column(3), part.column(4).to_numpy()
                least = part.column(5).fill_null(-MOST).to_numpy()
                for at in range(0, len(q_ids), 128):
                    r, vec, score = best(q_ids[at : at + 128], v[at : at + 128], least[at : at + 128], *ready, k)
                    if len(r):
                        yield pa.record_batch([rows.take(pa.array(r + at)), pa.array(q_ids[at : at + 128][r]), pa.array(vec), pa.array(score)], names=["row", "query_id", "vec_id", "score"])

    return run


FOUND = "row long, query_id long, vec_id long, score long"


def _local(asked: DataFrame, blocks: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``asked``: (row, query_id, v, c, least) meet the data rows of all blocks of cell number c."""
    parts = F.array(*map(F.lit, cells.parts))
    to = asked.select("c", F.explode(F.sequence(F.lit(0), parts[F.col("c")] - 1)).alias("block"), F.lit(1).alias("side"), "row", F.col("query_id").alias("id"), "least", "v")
    both = blocks.unionByName(to).repartition("c", "block").sortWithinPartitions("c", "block", "side")
    return both.mapInArrow(_solve(k, cells.pivots.shape[1]), FOUND)


def _one_length(data: DataFrame, queries: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame, Cells]:
    """(results per query row, the (query, cell) pairs that were sent on, the cells)."""
    rows, asked = data.where(F.size("v") == dim), queries.where(F.size("v") == dim)
    count = max(1, min(PIVOTS, PIVOT_NUMBERS // dim, round(rows.count() ** 0.5)))
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(DRAWN * count).collect()]
    pivots = place_pivots(np.array(drawn, np.float64).reshape(len(drawn), dim), count)
    celled = common.staged(rows.select("vec_id", "v").mapInArrow(_cells(pivots), f"vec_id long, v array<double>, {_CELL}"), "cells")
    cells = Cells(pivots, celled.groupBy("cell").agg(F.max("far").alias("far"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("off").alias("off"), F.count("*").alias("n")).orderBy("cell").collect())
    number = F.array(*(F.lit(int(x)) for x in np.searchsorted(cells.ids, np.arange(len(pivots)))))
    blocks = celled.select(number[F.col("cell")].alias("c"), "vec_id", "v")
    block = F.pmod(F.xxhash64("vec_id"), F.array(*map(F.lit, cells.parts))[F.col("c")]).cast("int")
    no = F.lit(None).cast("long")
    blocks = blocks.select("c", block.alias("block"), F.lit(0).alias("side"), no.alias("row"), F.col("vec_id").alias("id"), no.alias("least"), "v")
    # every query meets its own cell first; its k-th score there is what other cells must reach
    asked = asked.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("query_id"), "v")
    asked = common.staged(asked.mapInArrow(_home(cells), "row long, query_id long, v array<double>, g int, apart double"), "asked")
    first = common.staged(_local(asked.select("row", "query_id", "v", F.col("g").alias("c"), no.alias("least")), blocks, cells, k), "first")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    kth = first.withColumn("r", rank).where(F.col("r") == k).select("row", F.col("score").alias("least"))
    asked = common.staged(asked.join(kth, "row", "left"), "bounded")
    groups = asked.groupBy("g").agg(F.max("apart").alias("r"), F.min(F.coalesce("least", F.lit(-MOST))).alias("t")).collect()
    radii, least = np.zeros(len(cells.ids)), np.full(len(cells.ids), np.inf)
    for r in groups:
        radii[r["g"]], least[r["g"]] = r["r"], r["t"]
    allowed = ~(cells.group_bounds(radii) < least[:, None])
    sent = common.staged(asked.select("row", "query_id", "v", "g", "least").mapInArrow(_reach(cells, allowed), "row long, query_id long, v array<double>, c int, least long"), "sent")
    return first.unionByName(_local(sent, blocks, cells, k)), sent, cells


def _ready(df: DataFrame) -> DataFrame:
    v = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return v.where("vec_id is not null and v is not null and size(v) > 0").distinct()


def _inputs(data: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """Data rows, query rows and the vector lengths that both have. Of equal vectors only the k + 1 smallest vec_ids can ever be among a query's best."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = common.staged(_ready(data).withColumn("_r", place).where(F.col("_r") <= k + 1).select("vec_id", "v"), "data")
    asked = common.staged(_ready(queries), "queries")
    lengths = asked.select(F.size("v").alias("d")).distinct().intersect(rows.select(F.size("v").alias("d")).distinct())
    return rows, asked, sorted(r["d"] for r in lengths.collect())


def shipped_share(data: DataFrame, queries: DataFrame, k: int = 5) -> float:
    """The share of all (query, other cell) pairs over which a query is sent: 1 where nothing can be left out."""
    rows, asked, lengths = _inputs(data, queries, k)
    sent = pairs = 0
    for d in lengths:
        _, went, cells = _one_length(rows, asked, d, k)
        sent, pairs = sent + went.count(), pairs + asked.where(F.size("v") == d).count() * (len(cells.ids) - 1)
    return sent / max(1, pairs)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k largest integer inner products, exactly; ties to the smaller vec_id.

    ``data`` and ``queries``: vec_id, embedding (array of numbers); other
    columns are ignored. Components become floor(256 * x). Rows with a null
    vec_id, a null vector, or a component that is null or not finite (256-fold)
    take no part; vectors meet only vectors of their length; empty vectors take
    no part. A query never meets a row of its own vec_id. Repeated rows (vec_id
    and vector) count once; a vec_id with several vectors keeps its best score
    and one place. A score beyond a long counts as the nearest long. Fewer than
    k candidates are all returned; empty tables give no rows. Returns query_id,
    rank, vec_id, score.

    Rows belong to the cell of their nearest pivot, queries to the group of the
    pivot that scores highest with them. A query is solved in its group's cell
    first; its k-th score there is its threshold, the least one the group's.
    Summaries of the cells bound every score: a group leaves out the cells that
    none of its queries can reach, each query of the others those that its own
    bound doesn't reach, and goes to the rest. Data rows stay in their cell, in
    blocks of a bounded size; only queries, the smaller side, are replicated,
    and they pass by a block in batches. Where vectors have no clusters, as
    random ones in many dimensions, no bound can leave much out.
    """
    rows, asked, lengths = _inputs(data, queries, k)
    found = data.sparkSession.createDataFrame([], FOUND)
    for d in lengths:
        found = found.unionByName(_one_length(rows, asked, d, k)[0])
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = common.table(spark, sf_dir, "embeddings")
    return top_k(data, data.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, max(CAST(list_inner_product(q.v, e.v) AS BIGINT)) AS score
      FROM e q JOIN e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(q.v) = len(e.v) GROUP BY q.vec_id, e.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
