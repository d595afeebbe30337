"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees propose rules (each path from the root to a node is a
conjunction of thresholds on statistics), a lasso logistic regression keeps a
few of them, and the kept rules are compiled into one Spark column expression.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the fit reads at most: those with the smallest hash of doc_id. Scoring reads every row.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
#: The lasso's penalty per rule and its steps.
PENALTY, STEPS = 2e-3, 400

STATISTICS = (
    "chars", "words", "mean_word", "long_words", "distinct_words", "repeat_words", "lines", "distinct_lines", "short_lines",
    "upper", "digits", "spaces", "non_ascii", "marks", "stops", "bars", "shouted", "odd_ends", "bytes_entropy", "line_chars",
)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = {name: np.zeros(256, bool) for name in ("upper", "digits", "marks", "stops")}
_KIND["upper"][65:91] = True
_KIND["digits"][48:58] = True
_KIND["marks"][list(b"!#$%&*+/<=>@\\^_`{}~")] = True
_KIND["stops"][list(b".,;:?'\"")] = True
_ODD = frozenset(b"!#$%&*=|~^")


def statistics(text: bytes) -> tuple[float, ...]:
    """The statistics of a UTF-8 text, in the order of ``STATISTICS``; zeros for an empty one."""
    size = len(text)
    if not size:
        return (0.0,) * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    hist = np.bincount(raw, minlength=256)
    chars = size - int(hist[128:192].sum())
    words = text.split()
    lines = text.split(b"\n")
    n, m = max(1, len(words)), len(lines)
    distinct = len(set(words))
    share = hist[hist > 0] / size
    return (
        float(chars), float(len(words)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, distinct / n,
        float(len(words) - distinct) / n, float(m), len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m,
        hist[_KIND["upper"]].sum() / chars, hist[_KIND["digits"]].sum() / chars, hist[_SPACE].sum() / chars, hist[192:].sum() / chars,
        hist[_KIND["marks"]].sum() / chars, hist[_KIND["stops"]].sum() / chars, hist[124] / chars,
        sum(w.isupper() for w in words) / n, sum(w[-1] in _ODD for w in words) / n, float(-(share * np.log2(share)).sum()), chars / m,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("_text")
        names = [n for n in batch.schema.names if n != "_text"]
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            rows = np.array([statistics(t or b"") for t in part.column(at).to_pylist()], np.float64)
            yield pa.record_batch([part.column(n) for n in names] + [pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=[*names, *(f"_q_{s}" for s in STATISTICS)])


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and one column ``_q_<statistic>`` for each statistic of the whole text."""
    slim = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text"), *(f"_q_{s} double" for s in STATISTICS)])
    return slim.mapInArrow(_measure, kinds)


@dataclass(frozen=True)
class Model:
    """Rules ((statistic, is_above, threshold), ...) with their weights, and the intercept."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        """The score as a column expression over the ``_q_`` columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for name, above, at in rule:
                c = F.col(f"_q_{name}")
                test = test & ((c > at) if above else (c <= at))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], out: list, update: np.ndarray) -> None:
    """Grow one tree; every node's path joins ``out``, each leaf's step ``update``."""

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(rows) >= 20:
            for k in range(binned.shape[1]):
                gs = np.bincount(binned[rows, k], grad[rows], BINS + 1).cumsum()[:-1]
                hs = np.bincount(binned[rows, k], hess[rows], BINS + 1).cumsum()[:-1]
                ns = np.bincount(binned[rows, k], minlength=BINS + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 10) | (len(rows) - ns < 10)] = -1
                i = int(gain[: len(edges[k])].argmax()) if len(edges[k]) else 0
                if len(edges[k]) and gain[i] > best[0]:
                    best = (float(gain[i]), k, i)
        if best[1] < 0:
            update[rows] = -RATE * g / (h + 1)
            return
        _, k, i = best
        below = binned[rows, k] <= i
        for above, part in ((False, rows[below]), (True, rows[~below])):
            longer = (*path, (k, above, i))
            out.append(longer)
            grow(part, longer, depth + 1)

    grow(np.arange(len(grad)), (), 0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the ensemble to statistics ``x`` and labels ``y``. With fewer than two classes the score is the (smoothed) share of label 1."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    prior = float(np.log(share / (1 - share)))
    if n < 20 or y.min() == y.max():
        return Model((), (), prior)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    score, paths = np.full(n, prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(n)
        _tree(binned, p - y, p * (1 - p), edges, paths, step)
        score += step
    masks: dict[bytes, tuple] = {}
    for path in paths:  # of rules that hold for the same rows the first, shortest one counts
        hold = np.ones(n, bool)
        for k, above, i in path:
            hold &= (binned[:, k] > i) == above
        if 10 <= hold.sum() <= n - 10:
            masks.setdefault(np.packbits(hold).tobytes(), (path, hold))
    if not masks:
        return Model((), (), prior)
    rules = [m[0] for m in masks.values()]
    z = np.stack([m[1] for m in masks.values()], 1).astype(np.float64)
    w, b = _lasso(z, y.astype(np.float64), prior)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    named = tuple(tuple((STATISTICS[k], above, float(edges[k][i])) for k, above, i in rules[r]) for r in keep)
    return Model(named, tuple(float(w[r]) for r in keep), float(b))


def _lasso(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n = len(y)
    full = np.hstack([z, np.ones((n, 1))])
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / (np.linalg.norm(full @ v) ** 2 * 1.05)
    w = np.zeros(full.shape[1])
    w[-1] = prior
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(full @ ahead, -30, 30)))
        new = ahead - rate * (full.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - rate * PENALTY)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], w[-1]


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of doc_id as text leaves remainder 1 by 3. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` rows whose ids have a label and aren't held out.

    Ids without a label (0 or 1) or with both don't count. Of the rest the
    ``fit_rows`` with the smallest hash are looked up; if ids repeat in ``docs``,
    the first ``fit_rows`` rows in the order of that hash and their statistics.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_y"), F.max("quality").alias("_z")).where("_y = _z").drop("_z")
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)  # 12 bytes each
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    names = [f"_q_{s}" for s in STATISTICS]
    got = measured(rows.select(F.col("_id"), F.col("_y"), "text"), ["_id", "_y"]).orderBy(F.xxhash64("_id"), "_id", *names).limit(fit_rows).toPandas()
    return fit(got[names].to_numpy(np.float64).reshape(-1, len(STATISTICS)), got["_y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts count as empty; they have a score like any other. Null or
    repeated doc_ids are rows like any other, other columns are ignored, an
    empty table gives no rows. Labels, lang, source and doc_id are no inputs
    of the score.
    """
    rows = measured(docs, ["doc_id"]).withColumn("score", model.column())
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts as label 1, columns unchanged."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    return measured(renamed, names).where(model.column() >= 0.5).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


def crc_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 1
