"""The Pareto frontier of groups of any size.

A row is dominated if another is nowhere worse by more than the slack and somewhere better by more than it. The slack
makes that relation non-transitive, so rows can't be dropped one by one as they are found dominated. But a row that is
nowhere smaller than another dominates all that the other does: the maximal rows alone (by plain comparison, which is
transitive) decide about everybody. They are found in parts, merged, and then every row is held against them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import staged

#: What counts as equal (a fixed value), rows of a group up to which they meet in a window, rows of a part, and maximal rows that are compared at a time.
SLACK, SMALL, PART_ROWS, STEP = 1e-9, 256, 20_000, 64


def maximal(x: np.ndarray) -> np.ndarray:
    """Numbers of the rows that no other row equals or exceeds everywhere, one of equal rows; NaN counts as least.

    Sorted by their sums, then by their columns, largest first, a row can only be covered by one before it (rounding
    keeps the order of sums). Those kept so far are looked through in steps, which the rows that fall early hardly pay for.
    """
    x = np.where(np.isnan(x), -np.inf, x)
    order = np.lexsort([*x.T[::-1], x.sum(1)])[::-1]
    kept = np.zeros((0, x.shape[1]))
    out = [order[:0]]
    for at in range(0, len(order), 2 * STEP):
        block = order[at : at + 2 * STEP]
        for i in range(0, len(kept), STEP):
            block = block[~(kept[None, i : i + STEP] >= x[block][:, None]).all(2).any(1)]
            if not len(block):
                break
        own = x[block]
        covered = (own[None, :] >= own[:, None]).all(2) & np.tri(len(block), k=-1, dtype=bool)
        out.append(block[~covered.any(1)])
        kept = np.concatenate([kept, x[out[-1]]])
    return np.concatenate(out)


def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` some row of ``by`` dominates; ``by`` is looked through from the largest sum on, and rows that fall early leave."""
    by = by[np.argsort(-by.sum(1), kind="stable")]
    out, left = np.zeros(len(x), bool), np.arange(len(x))
    for at in range(0, len(by), STEP):
        some = by[at : at + STEP]
        for i in range(0, len(left), 4096):
            rows = left[i : i + 4096]
            own = x[rows][:, None]
            out[rows] = ((some >= own - SLACK).all(2) & (some > own + SLACK).any(2)).any(1)
        left = left[~out[left]]
        if not len(left):
            break
    return out


def _runs(batch: pa.RecordBatch, keys: list[int]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted batch that agree in the key columns."""
    values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], batch.slice(start, i - start)
            start = i


def _numbers(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)], 1).astype(np.float64)


def _maximal_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns g, part, then the numbers; rows sorted by both. The maximal rows of each part, held as few as they are."""
    key, kept, names = None, None, None

    def given():
        n = len(kept)
        return pa.record_batch([pa.array([key[0]] * n, pa.string()), *(pa.array(c) for c in kept.T)], names=[names[0], *names[2:]])

    for batch in batches:
        names = batch.schema.names
        for k, part in _runs(batch, [0, 1]):
            if k != key and kept is not None and len(kept):
                yield given()
            x = _numbers(part, 2)
            if k == key:
                x = np.concatenate([kept, x])
            key, kept = k, x[maximal(x)]
    if kept is not None and len(kept):
        yield given()


def _held_against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns g, part, side, row, then the numbers: side 0 are the group's maximal rows, which come first, side 1 its rows."""
    key, by = None, []
    for batch in batches:
        for k, part in _runs(batch, [0, 1, 2]):
            if k[:2] != key:
                key, by = k[:2], []
            x = _numbers(part, 4)
            if k[2] == 0:
                by.append(x)
                continue
            worse = dominated(np.where(np.isnan(x), -np.inf, x), np.concatenate(by))
            yield pa.record_batch([part.column(3), pa.array(~worse)], names=["row", "on_frontier"])


def frontier(df: DataFrame, group: str, names: tuple[str, ...]) -> DataFrame:
    """Add ``on_frontier``: no row of the same ``group`` dominates in the columns ``names`` (larger is better).

    Null and NaN count as less than anything; a null group is a group of its own; equal rows don't dominate each other.
    Rows are written once, as they are read twice. Groups of up to SMALL rows meet in a window. Of larger ones the
    maximal rows of parts of PART_ROWS rows are found, those of all parts together, and each part of the group is held
    against them: no task holds more of a group than a part and its maximal rows. A frontier of a large share of a
    large group, as many numbers in opposition to each other give, is compared with all its rows.
    """
    numbers = [F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names]
    rows = staged(df.select(F.struct("*").alias("r"), F.col(group).cast("string").alias("g"), F.monotonically_increasing_id().alias("row"), *(x.alias(f"x{i}") for i, x in enumerate(numbers))), "frontier")
    xs = [f"x{i}" for i in range(len(names))]
    sizes = rows.groupBy("g").agg(F.count("*").alias("size"))
    large = staged(sizes.where(F.col("size") > SMALL).withColumn("parts", F.ceil(F.col("size") / PART_ROWS).cast("int")), "large")
    same = F.col("g").eqNullSafe(F.col("lg"))
    least = large.select(F.col("g").alias("lg"), "parts")
    small = rows.join(least, same, "left_anti")
    own = F.struct(*(F.nanvl(F.col(x), F.lit(float("-inf"))).alias(x) for x in xs))
    worse = " and ".join(f"y.{x} >= _own.{x} - {SLACK!r}D" for x in xs) + " and (" + " or ".join(f"y.{x} > _own.{x} + {SLACK!r}D" for x in xs) + ")"
    met = small.withColumn("_own", own).withColumn("_all", F.collect_list("_own").over(Window.partitionBy("g")))
    out = met.select("r.*", F.expr(f"not exists(_all, y -> {worse})").alias("on_frontier"))
    if large.isEmpty():
        return out
    many = rows.join(least, same).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    types = ", ".join(f"{x} double" for x in xs)
    found = many.select("g", "part", *xs).repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(_maximal_of_parts, f"g string, {types}")
    best = found.select("g", F.lit(0).alias("part"), *xs).repartition("g").sortWithinPartitions("g").mapInArrow(_maximal_of_parts, f"g string, {types}")
    best = staged(best, "maximal")
    to_all = best.join(least, F.col("g").eqNullSafe(F.col("lg"))).select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("row"), *xs)
    asked = many.select("g", "part", F.lit(1).alias("side"), "row", *xs)
    told = to_all.unionByName(asked).repartition("g", "part").sortWithinPartitions("g", "part", "side").mapInArrow(_held_against, "row long, on_frontier boolean")
    return out.unionByName(rows.join(told, "row").select("r.*", "on_frontier"))
