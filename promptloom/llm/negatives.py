"""Hard-negative mining over one-dimensional distance keys: augmented vectors lie sorted by (pivot, distance), and each
anchor searches annuli, nearest first, until what is left cannot hold a better row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .knn import DRAWN, MOST, NONE, _matrix, exact_scores, place_pivots, quantised

#: Pivots at most, rings of each at most, rows that make a ring worth while, data rows of one block, and the shares of its annuli that an anchor has passed after each round.
PIVOTS, RINGS, RING_ROWS, BLOCK_ROWS, SHARES = 64, 64, 1024, 16_384, (1 / 16, 1 / 4, 1.0)
#: Components from here on make products leave the exact range of doubles: such rows have no key, and every anchor looks at them.
WIDE = 2.0**26
FOUND = "row long, band int, vec_id long, score long"


class Annuli:
    """The directory: each annulus' pivot, its least and largest distance, and the blocks that hold its rows. The last one may be that of the wide rows."""

    def __init__(self, pivots: np.ndarray, top: float, rows: list) -> None:
        self.pivots, self.top = pivots, top
        self.pivot = np.array([r["pivot"] for r in rows], np.int64)
        self.low, self.high = (np.array([np.nan if r["pivot"] < 0 else r[c] for r in rows], np.float64) for c in ("low", "high"))
        self.parts = [-(-r["n"] // BLOCK_ROWS) for r in rows]

    def apart(self, x: np.ndarray, filled: bool) -> np.ndarray:
        """Distances to all pivots of rows (augmented by what their squares lack of the largest) or of anchors (augmented by 0)."""
        with np.errstate(over="ignore", invalid="ignore"):
            rest = np.sqrt(np.maximum(0, self.top - (x**2).sum(1))) if filled else np.zeros(len(x))
            return np.sqrt(((x[:, None, :] - self.pivots[None, :, :-1]) ** 2).sum(2) + (rest[:, None] - self.pivots[:, -1]) ** 2)

    def bounds(self, apart: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that a row of an annulus (columns) scores with an anchor (rows); NaN where nothing can be said."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.where(np.isfinite(apart), apart, np.nan)[:, self.pivot]
            both = square[:, None] + self.top
            near = np.maximum(0, np.maximum(self.low - d, d - self.high))
            slack = 1e-9 * (1 + both)
            return (both - near**2) / 2 + slack, (both - (d + self.high) ** 2) / 2 - slack


def _keyed(annuli: Annuli):
    """Each row's nearest pivot and its distance to it; wide rows have pivot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = _matrix(part.column(2), annuli.pivots.shape[1] - 1)
                apart = annuli.apart(x, filled=True)
                wide = (np.abs(x) >= WIDE).any(1)
                pivot = np.where(wide, -1, apart.argmin(1))
                key = np.where(wide, 0, apart[np.arange(len(x)), pivot])
                yield pa.record_batch([*part.columns, pa.array(pivot.astype(np.int32)), pa.array(key)], names=["vec_id", "label", "v", "pivot", "key"])

    return run


def _distances(annuli: Annuli):
    """Each anchor's distances to the pivots, worked out once: all rounds see the same bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                apart = annuli.apart(_matrix(part.column(3), annuli.pivots.shape[1] - 1), filled=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(apart) + 1) * apart.shape[1], pa.int32()), pa.array(apart.ravel()))
                yield pa.record_batch([*part.columns, lists], names=["row", "anchor_id", "label", "v", "apart"])

    return run


def _next(annuli: Annuli, first: int, last: int):
    """The annuli that an anchor has to look at among its ``first``th to ``last``th in the order of their best scores: those that may hold a row of one of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                v = _matrix(part.column(3), annuli.pivots.shape[1] - 1)
                with np.errstate(over="ignore"):
                    best, least = annuli.bounds(_matrix(part.column(4), len(annuli.pivots)), (v**2).sum(1))
                order = np.argsort(-best, axis=1, kind="stable")[:, first:last]  # NaN, nothing known, comes last
                best, least = np.take_along_axis(best, order, 1), np.take_along_axis(least, order, 1)
                need = np.zeros(best.shape, bool)
                for i, (lows, highs) in enumerate(zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)):
                    for low, high in zip(lows, highs, strict=True):
                        need[i] |= ~(best[i] < low) & ~(least[i] > high)
                rows, c = np.nonzero(need)
                for i in range(0, len(rows), 10_000):
                    take = pa.array(rows[i : i + 10_000])
                    to = order[rows[i : i + 10_000], c[i : i + 10_000]].astype(np.int32)
                    yield pa.record_batch([*(part.column(k).take(take) for k in (0, 1, 2, 3, 5, 6)), pa.array(to)], names=["row", "id", "label", "v", "lows", "highs", "a"])

    return run


def first_in_bands(score: np.ndarray, fits: np.ndarray, lows: list[list[int]], highs: list[list[int]], k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(anchors, band, columns): the ``k`` best fitting columns of each anchor within each of its bands, ties to the earlier column."""
    n = min(k, score.shape[1])
    for band in range(max(map(len, lows), default=0)):
        low = np.array([x[band] if band < len(x) else MOST for x in lows])[:, None]
        high = np.array([x[band] if band < len(x) else -MOST for x in highs])[:, None]
        s = np.where(fits & (score >= low) & (score <= high), score, NONE)
        edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n : s.shape[1] - n + 1]
        r, c = np.nonzero((s >= edge) & (s > NONE))
        order = np.lexsort((c, -s[r, c], r))
        r, c = r[order], c[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < n
        yield r[keep], band, c[keep]


def _solve(k: int, dim: int, same: bool):
    """Blocks one after another: a block's rows are held, its anchors pass by, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)  # annulus, block, side
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cut], [*cut, len(keys)], strict=True):
                if a == b:
                    continue
                if tuple(keys[a, :2]) != block:
                    block, held, ready = tuple(keys[a, :2]), [], None
                part = batch.slice(a, b - a)
                ids, labels, v = part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(8), dim)
                if keys[a, 2] == 0:
                    held.append((ids, labels, v))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*held, strict=True)]
                    order = np.argsort(ready[0], kind="stable")
                    ready = [x[order] for x in ready]
                for at in range(0, len(ids), 64):
                    to = slice(at, at + 64)
                    score = exact_scores(v[to], ready[2])
                    fits = ((labels[to, None] == ready[1][None, :]) == same) & (ids[to, None] != ready[0][None, :])
                    lows, highs = (part.column(i).slice(at, 64).to_pylist() for i in (6, 7))
                    for r, band, c in first_in_bands(score, fits, lows, highs, k):
                        if len(r):
                            yield pa.record_batch([part.column(3).take(pa.array(r + at)), pa.array(np.full(len(r), band, np.int32)), pa.array(ready[0][c]), pa.array(score[r, c])], names=["row", "band", "vec_id", "score"])

    return run


class Index:
    """The rows of one vector length, stored sorted by (annulus, key), and their directory."""

    def __init__(self, rows: DataFrame, dim: int) -> None:
        spark, self.dim = rows.sparkSession, dim
        narrow = rows.where(~F.exists("v", lambda x: F.abs(x) >= WIDE))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        about = narrow.agg(F.count("*").alias("n"), F.max(square).alias("top")).first()
        count = max(1, min(PIVOTS, round(about["n"] ** 0.5 / 8)))
        top = about["top"] or 0.0
        drawn = np.array([r["v"] for r in narrow.orderBy(F.xxhash64("vec_id", "v"), "vec_id").select("v").limit(DRAWN * count).collect()], np.float64).reshape(-1, dim)
        augmented = np.c_[drawn, np.sqrt(np.maximum(0, top - (drawn**2).sum(1)))]
        pivots = place_pivots(augmented, count) if len(drawn) else np.zeros((1, dim + 1))
        keyed = common.staged(rows.mapInArrow(_keyed(Annuli(pivots, top, [])), "vec_id long, label long, v array<double>, pivot int, key double"), "keyed")
        # cuts between a pivot's rings: even shares of its rows
        edges = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("key", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
        rings = F.least(F.lit(RINGS), F.greatest(F.lit(1), F.ceil(F.col("n") / RING_ROWS))).cast("int")
        every = F.filter(F.col("cuts"), lambda x, i: F.floor((i + 1) * rings / RINGS) > F.floor(i * rings / RINGS))
        ring = F.size(F.filter("cuts", lambda x: x < F.col("key")))
        ringed = keyed.join(F.broadcast(edges.select("pivot", every.alias("cuts"))), "pivot").select("pivot", ring.alias("ring"), "key", "vec_id", "label", "v")
        rows = ringed.groupBy("pivot", "ring").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).orderBy("pivot", "ring").collect()
        self.annuli = Annuli(pivots, top, rows)
        number = spark.createDataFrame([(r["pivot"], r["ring"], i, p) for i, (r, p) in enumerate(zip(rows, self.annuli.parts, strict=True))], "pivot int, ring int, a int, parts int")
        placed = ringed.join(F.broadcast(number), ["pivot", "ring"])
        block = F.pmod(F.xxhash64("vec_id"), "parts").cast("int")
        self.rows = common.staged(placed.select("a", block.alias("block"), "key", "vec_id", "label", "v").repartitionByRange("a", "block", "key").sortWithinPartitions("a", "block", "key"), "annuli")
        common.forget(keyed)

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, band, vec_id, score): the ``k`` best rows within each band of each anchor, of its label or of any other.

        ``asked``: row, anchor_id, label, v, lows, highs. A band is given by its least and largest score; its least one
        rises to the k-th score found. An anchor's annuli are ordered by the best score that they may hold; each round
        takes it further down that order, past those that none of its bands can use.
        """
        away = asked.select("row", "anchor_id", "label", "v").mapInArrow(_distances(self.annuli), "row long, anchor_id long, label long, v array<double>, apart array<double>")
        asked = common.staged(away.join(asked.select("row", "lows", "highs"), "row"), "asked")
        found, parts, first = None, F.array(*map(F.lit, self.annuli.parts)), 0
        no, none = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
        for share in SHARES:
            last = max(first, round(len(self.annuli.parts) * share) if share < 1 else len(self.annuli.parts))
            bands = asked if found is None else asked.join(_thresholds(found, k), "row", "left").withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("least", i), x)))).drop("least")
            sent = bands.select("row", "anchor_id", "label", "v", "apart", "lows", "highs").mapInArrow(_next(self.annuli, first, last), "row long, id long, label long, v array<double>, lows array<long>, highs array<long>, a int")
            sent, first = common.staged(sent, "sent"), last
            # the directory bounds the distinct annuli
            here = self.rows.join(F.broadcast(sent.select("a").distinct()), "a", "left_semi")
            data = here.select("a", "block", F.lit(0).alias("side"), no.alias("row"), F.col("vec_id").alias("id"), "label", none.alias("lows"), none.alias("highs"), "v")
            to = sent.select("a", F.explode(F.sequence(F.lit(0), parts[F.col("a")] - 1)).alias("block"), F.lit(1).alias("side"), "row", "id", "label", "lows", "highs", "v")
            met = data.unionByName(to).repartition("a", "block").sortWithinPartitions("a", "block", "side").mapInArrow(_solve(k, self.dim, same), FOUND)
            both = met if found is None else found.unionByName(met)
            new = common.staged(_first(both, k), "found")
            for gone in (sent, found):
                if gone is not None:
                    common.forget(gone)
            found = new
        common.forget(asked)
        return found

    def close(self) -> None:
        common.forget(self.rows)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _thresholds(found: DataFrame, k: int) -> DataFrame:
    """(row, least): the k-th score of each band that has as many rows."""
    full = found.groupBy("row", "band").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    return full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("least"))


def _part(score: str, percent: int, up: bool) -> Column:
    """``percent`` of a score >= 0, rounded up or down, without leaving the longs."""
    return F.expr(f"({score} div 100) * {percent} + (({score} % 100) * {percent} + {99 if up else 0}) div 100")


def _ready(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding")).alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").distinct()


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(data: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its positives, the first rows of another label whose score lies between ``low`` and ``high`` per cent of the positive's.

    ``data`` and ``anchors``: vec_id, label, embedding; other columns are
    ignored. Components become floor(256 * x); a score is the integer inner
    product, higher ones come first, ties by the smaller vec_id. Positives are
    an anchor's first ``positives`` other rows of its label, fewer where there
    are fewer. A positive with a negative score has no negatives. Rows with a
    null vec_id, label or vector, or a component that is null or not finite
    take no part, empty vectors neither; vectors meet only vectors of their
    length. Equal rows count once; rows that share a vec_id are rows of their
    own, but never meet each other. Scores beyond a long count as the nearest
    one. Empty tables give no rows. Returns anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Vectors are augmented so that inner products become distances, keyed by
    their nearest pivot and the distance to it, and stored in that order, cut
    into rings of even counts. The distance of an anchor to the pivots bounds
    what a ring may hold, from above and below; so the search for positives
    passes by rings that are too far, that for negatives also those that are
    too near. Rings are read in blocks of a bounded size; of equal vectors of a
    label only as many as can be asked for stay. Where vectors have no
    clusters, as random ones in many dimensions, every ring has to be searched.
    """
    spark, most = data.sparkSession, max(positives, negatives) + 1
    place = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    rows = common.staged(_ready(data).withColumn("_r", place).where(F.col("_r") <= most).drop("_r"), "rows")
    asked = common.staged(_ready(anchors).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    lengths = asked.select(F.size("v").alias("d")).distinct().intersect(rows.select(F.size("v").alias("d")).distinct())
    out = spark.createDataFrame([], MINED)
    for dim in sorted(r["d"] for r in lengths.collect()):
        index, here = Index(rows.where(F.size("v") == dim), dim), asked.where(F.size("v") == dim)
        least, largest = (F.array(F.lit(x).cast("long")) for x in (-MOST, MOST))
        found = index.search(here.withColumns({"lows": least, "highs": largest}), positives, same=True)
        found = found.where("score >= 0").select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        # an anchor's positives of equal score share a band
        band = (F.dense_rank().over(Window.partitionBy("row").orderBy("positive_score")) - 1).alias("band")
        found = common.staged(found.select("*", band, _part("positive_score", low, True).alias("low"), _part("positive_score", high, False).alias("high")), "positives")
        bands = found.select("row", "band", "low", "high").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("band", "low", "high"))).alias("x"))
        bands = here.join(bands.select("row", F.col("x.low").alias("lows"), F.col("x.high").alias("highs")), "row")
        got = index.search(bands, negatives, same=False)
        rank = F.row_number().over(Window.partitionBy("row", "band").orderBy(F.desc("score"), "vec_id")).cast("int")
        got = got.select("row", "band", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        mined = got.join(found, ["row", "band"]).join(here.select("row", "anchor_id"), "row")
        out = out.unionByName(mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        index.close()
    return out


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector as an anchor against all rows; every seventh vector's label counts as the next one."""
    data = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    data = data.withColumn("label", label)
    return hard_negatives(data, data.where(F.col("vec_id") % 50 == 0))


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM e a JOIN e ON a.vec_id % 50 = 0 AND e.vec_id <> a.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
