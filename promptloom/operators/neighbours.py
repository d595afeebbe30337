"""Exact nearest neighbours by the dot product, with two sides of any size: blocks of queries meet blocks of entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged

#: Rows of a block of queries, on average (2 KB each at 256 dimensions), how many times as many entries pass by it in one task, and rows that are compared at a time.
BLOCK, PASSING, STEP = 4096, 64, 1000
#: Blocks of queries that a task holds at most, blocks for each of Spark's slots before it holds more than one, tasks of a grid at most.
WIDE, EACH, TASKS = 4, 2, 5000
#: Entries that are compared at a time, the share of pairs (one of MANY) beyond which all are worked out anew, components of pairs that are worked out at a time, the size up to which single precision serves.
TILE, MANY, PIECE, LARGE = 512, 16, 2**20, 1e15
#: Where there is no id yet.
NONE = np.iinfo(np.int64).max
FOUND = "query_id long, id long, similarity double"


def vectors(column: pa.Array) -> np.ndarray:
    """Rows of vectors; missing components, as those of shorter vectors, are 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.nan_to_num(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    out = np.zeros((len(column), lengths.max(initial=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers as bytes, ``counts`` of them to a row: on their way through Spark arrays cost several times as much."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many of each row) of ``binary``."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // size, ends[0]) if ends[-1] > ends[0] else np.zeros(0, kind)
    return data, np.diff(ends) // size


def packed(column: pa.Array) -> pa.Array:
    """Vectors as bytes, with the precision that they have."""
    x = vectors(column)
    with np.errstate(over="ignore"):
        x = x.astype(np.float32 if column.type.value_type == pa.float32() else np.float64)
    return binary(x.ravel(), np.full(len(x), x.shape[1]))


def unpacked(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """The vectors of ``packed``; missing components are 0."""
    flat, lengths = numbers(column, kind)
    flat = np.nan_to_num(flat.astype(np.float64))
    if len(lengths) and (lengths == lengths[0]).all():
        return flat.reshape(len(lengths), -1) if lengths[0] else np.zeros((len(lengths), 0))
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def similarities(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Dot products over the shorter length."""
    wide = min(q.shape[1], x.shape[1])
    return q[:, :wide] @ x[:, :wide].T


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest scores of each row, equal to twelve digits by column."""
    n = min(k, score.shape[1])
    edge = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n : score.shape[1] - n + 1]
    r, c = np.nonzero(score >= edge - 1e-12)
    order = np.lexsort((c, -np.round(score[r, c], 12), r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < n
    return r[keep], c[keep]


def _found(asked: pa.RecordBatch, names: np.ndarray, x: np.ndarray, k: int, read) -> Iterator[pa.RecordBatch]:
    """``asked``: query_id, vector."""
    for at in range(0, asked.num_rows if len(names) else 0, STEP):
        part = asked.slice(at, STEP)
        score = similarities(read(part.column(1)), x)
        r, c = best(score, k)
        yield pa.record_batch([part.column(0).take(pa.array(r)), pa.array(names[c]), pa.array(score[r, c])], names=["query_id", "id", "similarity"])


def parts(df: DataFrame, block: int, wide: int = 1) -> int:
    """Blocks that the rows are dealt to: of ``wide`` times ``block`` rows, smaller ones while Spark's slots have fewer than EACH."""
    rows, slots = df.count(), EACH * df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // (block * wide)), min(-(-rows // block), slots))


def dealt(grid: DataFrame, q: int, e: int) -> DataFrame:
    """Each cell (qb, eb) of the grid in a task of its own, up to TASKS of them."""
    return grid.repartitionById(min(q * e, TASKS), F.pmod(F.col("qb").cast("long") * e + F.col("eb"), F.lit(min(q * e, TASKS))).cast("int"))


def cells(queries: DataFrame, entries: DataFrame, block: int = BLOCK, q: int | None = None, e: int | None = None) -> DataFrame:
    """Both sides (query_id or id, vector) in a grid: (eb, qb, side, id, vector). Every query meets every entry in one cell; a cell has about ``block`` queries and PASSING times as many entries at most, where ``q`` and ``e`` don't say how many blocks there are."""
    e, q = (n or max(1, -(-df.count() // size)) for df, n, size in ((entries, e, block * PASSING), (queries, q, block)))
    of = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(every(e).alias("eb"), of("query_id", q).alias("qb"), F.lit(0).alias("side"), F.col("query_id").alias("id"), "vector")
    held = entries.select(of("id", e).alias("eb"), every(q).alias("qb"), F.lit(1).alias("side"), "id", "vector")
    return asked.unionByName(held)


def runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted batch that agree in its first ``keys`` columns, which are numbers, and what follows those columns."""
    values = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(keys)], 1)
    cut = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
    rest = batch.select(range(keys, batch.num_columns))
    for a, b in zip([0, *cut], [*cut, len(values)], strict=True):
        if b > a:
            yield tuple(values[a].tolist()), rest.slice(a, b - a)


class Top:
    """Some queries and the k best entries of each so far: by similarity to twelve digits, of equal ones those of smaller ids.

    Pairs meet in single precision. Only those that may count, by what that can be off at most, are worked out in double
    precision, and wait in spare slots of their query until these are full.
    """

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k, self.spare = q, k, max(k, 16)
        shape = len(q), k + self.spare
        self.score, self.ids = np.full(shape, -np.inf), np.full(shape, NONE)
        self.used = np.full(len(q), k)
        self.least, self.last = np.full(len(q), -np.inf), np.full(len(q), NONE)  # of the k-th
        self.size = np.sqrt((q**2).sum(1))
        self.low = q.astype(np.float32) if self.size.max(initial=0) < LARGE else None
        self.about, self.near = np.empty(STEP * TILE, np.float32), np.zeros(STEP * TILE + 8, bool)  # new ones for each tile would cost as much as the product

    def take(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Entries, for the queries ``rows`` (all of them)."""
        wide = min(self.q.shape[1], x.shape[1])
        for i in range(0, len(ids), TILE):
            some, y = ids[i : i + TILE], np.zeros((len(ids[i : i + TILE]), self.q.shape[1]))
            y[:, :wide] = x[i : i + TILE, :wide]
            size = np.sqrt((y**2).sum(1)).max()
            low = y.astype(np.float32) if self.low is not None and size < LARGE else None
            for j in range(0, len(self.q) if rows is None else len(rows), STEP):
                at = slice(j, min(j + STEP, len(self.q))) if rows is None else rows[j : j + STEP]
                self._meet(at, some, y, low, size)

    def _meet(self, at: slice | np.ndarray, ids: np.ndarray, y: np.ndarray, low: np.ndarray | None, size: float) -> None:
        rows, few = np.arange(at.start, at.stop) if isinstance(at, slice) else at, False
        if low is not None:
            least, n = self.least[at], len(rows) * len(ids)
            off = (y.shape[1] + 8) * 2.0**-23 * size * self.size[at] + 2.0**-22 * np.abs(least) + 2e-12
            about = np.matmul(self.low[at], low.T, out=self.about[:n].reshape(len(rows), -1))
            np.greater_equal(about, (least - off).astype(np.float32)[:, None], out=self.near[:n].reshape(about.shape))
            self.near[n : n + 8] = False
            eight = np.flatnonzero(self.near[: -(-n // 8) * 8].view(np.uint64))  # eight pairs at a time, as few are near
            if not len(eight):
                return
            e, bit = np.nonzero(self.near[: -(-n // 8) * 8].reshape(-1, 8)[eight])
            r, c = np.divmod(eight[e] * 8 + bit, len(ids))
            few = len(r) * MANY <= n
        if not few:
            true = self.q[rows] @ y.T
            counts = self._counts(true, self.least[rows][:, None], ids, self.last[rows][:, None])
            true[~counts] = -np.inf
            n = min(self.k, len(ids))
            edge = np.partition(true, len(ids) - n, axis=1)[:, len(ids) - n, None]
            r, c = np.nonzero(counts & (true >= edge - 1e-12))
            self._add(rows[r], ids[c], true[r, c])
            return
        step = max(1, PIECE // max(1, y.shape[1]))
        true = np.concatenate([np.einsum("ij,ij->i", self.q[rows[r[i : i + step]]], y[c[i : i + step]]) for i in range(0, len(r), step)])
        keep = self._counts(true, self.least[rows[r]], ids[c], self.last[rows[r]])
        self._add(rows[r[keep]], ids[c[keep]], true[keep])

    @staticmethod
    def _counts(true: np.ndarray, least: np.ndarray, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which may come before the k-th so far."""
        return (true > least + 4e-13) | ((true >= least - 6e-13) & (ids < last))

    def _add(self, r: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Entries of queries ``r``; those of a query are together."""
        while len(r):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            size = np.diff(np.append(first, len(r)))
            nth = np.arange(len(r)) - np.repeat(first, size)
            rows, count = r[first], np.minimum(size, self.spare)
            self._settle(rows[self.used[rows] + count > self.score.shape[1]])
            more = nth >= self.spare
            later = r[more], ids[more], score[more]
            if len(later[0]):
                r, ids, score, nth = r[~more], ids[~more], score[~more], nth[~more]
            at = r * self.score.shape[1] + self.used[r] + nth
            self.score.ravel()[at], self.ids.ravel()[at] = score, ids
            self.used[rows] += count
            r, ids, score = later

    def _settle(self, every: np.ndarray) -> None:
        """The k best of the slots of these queries; the spare ones are free again."""
        for i in range(0, len(every), STEP):
            rows = every[i : i + STEP]
            score, ids = self.score[rows], self.ids[rows]
            first = np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
            edge = np.take_along_axis(score, first, 1).min(1)
            tied = np.flatnonzero((edge > -np.inf) & ((score >= edge[:, None] - 1e-12).sum(1) > self.k))
            if len(tied):
                first[tied] = np.lexsort((ids[tied], -np.round(score[tied], 12)), axis=-1)[:, : self.k]
            score, ids = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)
            self.score[rows, : self.k], self.ids[rows, : self.k], self.score[rows, self.k :], self.ids[rows, self.k :] = score, ids, -np.inf, NONE
            self.used[rows] = self.k
            rounded = np.round(score, 12)
            self.least[rows] = rounded.min(1)
            self.last[rows] = np.where(rounded == self.least[rows][:, None], ids, -1).max(1)

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, ids) of k entries of each query, in any order; those without similarity are none."""
        self._settle(np.flatnonzero(self.used > self.k))
        return self.score[:, : self.k], self.ids[:, : self.k]


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def _rows(names: pa.Array, top: Top) -> pa.RecordBatch:
    score, ids = top.settled()
    r, c = np.nonzero(score > -np.inf)
    return pa.record_batch([names.take(pa.array(r)), pa.array(ids[r, c]), pa.array(score[r, c])], names=["query_id", "id", "similarity"])


def together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _solve(k: int, scale: bool, kind: type):
    """Cells one after another: a block of queries is held, the entries (numbers of ``kind``) pass by; what is given is k rows of each query."""
    read = lambda column, of: unit(unpacked(column, of)) if scale else unpacked(column, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready, names = None, [], None, None
        for batch in batches:
            for key, part in runs(batch, 3):
                if key[:2] != cell:
                    if ready is not None:
                        yield _rows(names, ready)
                    cell, held, ready = key[:2], [], None
                if key[2] == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        own = together(held)
                        names, ready = own.column(0), Top(read(own.column(1), np.float64), k)
                    ready.take(part.column(0).to_numpy(), read(part.column(1), kind))
        if ready is not None:
            yield _rows(names, ready)

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of what was found in parts: each partition keeps k of a query's rows before they move."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def nearest(queries: DataFrame, entries: DataFrame, k: int, block: int = BLOCK, scale: bool = False) -> DataFrame:
    """The k entries (id long, vector) that are most similar to each query (query_id long, vector): query_id, id, similarity.

    Similarity is the dot product of normalised vectors (``scale``: of any, which are normalised on the way); ties go to the smaller
    id; null vectors take no part; ids of either side must be unique. Entries
    of one block are sent to all queries. Of more entries, both sides are
    written once and dealt to a grid of blocks, and what the cells found is
    merged: no task holds more than WIDE blocks of queries, nor sees more than PASSING blocks of entries.
    """
    single = scale and entries.schema["vector"].dataType.simpleString() == "array<float>"
    side = lambda df, name, kind: df.where("vector is not null").select(F.col(name).cast("long").alias(name), F.col("vector").cast(f"array<{kind}>").alias("vector"))
    queries, entries = side(queries, "query_id", "double"), side(entries, "id", "float" if single else "double")
    few = entries.limit(block + 1).toArrow()
    if len(few) <= block:
        few = few.sort_by("id").combine_chunks()
        read = (lambda column: unit(vectors(column))) if scale else vectors
        names, x = few.column(0).to_numpy(), read(few.column(1).combine_chunks())
        return queries.mapInArrow(lambda batches: (out for batch in batches for out in _found(batch, names, x, k, read)), FOUND)
    pack = lambda batches: (pa.record_batch([b.column(0), packed(b.column(1))], names=[b.schema.names[0], "vector"]) for b in batches)
    queries, entries = staged(queries.mapInArrow(pack, "query_id long, vector binary"), "queries"), staged(entries.mapInArrow(pack, "id long, vector binary"), "entries")
    q, e = parts(queries, block, WIDE), max(1, -(-entries.count() // (block * PASSING)))
    grid = dealt(cells(queries, entries, block, q, e), q, e)
    return merged(grid.sortWithinPartitions("eb", "qb", "side", "id").mapInArrow(_solve(k, scale, np.float32 if single else np.float64), FOUND), k)
