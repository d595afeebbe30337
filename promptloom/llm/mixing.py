"""Mixing sources to target weights by Pfair scheduling. DataFrame and SQL functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common

#: Target weights of the production mix; sources not named here, the null source included, weigh ``DEFAULT_WEIGHT``.
TARGET_WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 4, "src4": 4, **{f"src{i}": 2 for i in range(5, 20)}}
DEFAULT_WEIGHT = 1
#: Rows of one block.
BLOCK_ROWS = 4
#: Patterns of at most so many slots are broadcast; longer ones are joined by shuffle.
BROADCAST_SLOTS = 1_000_000
ADDED = ("weight", "block", "slot", "position")
_NULL = "\0null"

#: One period of the schedule. In slot t a source's next block (the j-th, from 1) is
#: eligible if its release floor((j - 1) * W / w) has come; of the eligible blocks the one with the
#: earliest deadline ceil(j * W / w) gets the slot, ties to the earlier source. Sources of one weight
#: share their releases and deadlines, so they take turns and one counter per weight is enough; the slots
#: are folded in runs, so no long array is copied slot by slot.
_TURN = """
aggregate(
  array(array_min(transform(
    filter(sequence(0, size(kinds) - 1), k -> ((u.c[k] div kinds[k].m) * period) div kinds[k].w <= t),
    k -> struct(((u.c[k] div kinds[k].m + 1) * period + kinds[k].w - 1) div kinds[k].w as d, kinds[k].members[cast(u.c[k] % kinds[k].m as int)] as i, k as k)))),
  u,
  (a, b) -> named_struct('c', transform(a.c, (x, k) -> if(k = b.k, x + 1L, x)),
                         'o', array_append(a.o, named_struct('i', b.i, 'k', a.c[b.k] div kinds[b.k].m))))
"""
_RUN = 512
_EDF = f"""
flatten(aggregate(sequence(0L, (period - 1) div {_RUN}),
  named_struct('c', transform(kinds, x -> 0L), 'o', cast(array() as array<array<struct<i:int,k:bigint>>>)),
  (s, r) -> aggregate(
    array(aggregate(sequence(r * {_RUN}, least(period, (r + 1) * {_RUN}) - 1),
      named_struct('c', s.c, 'o', cast(array() as array<struct<i:int,k:bigint>>)),
      (u, t) -> {_TURN})),
    s,
    (a, b) -> named_struct('c', b.c, 'o', array_append(a.o, b.o))),
  s -> s.o))
"""


def source_key(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(_NULL))


def _weight(weights: dict[str, int], default: int) -> Column:
    if any(w < 1 for w in [*weights.values(), default]):
        raise ValueError("weights are positive integers")
    named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, int(w))]) if weights else None
    return (F.lit(default) if named is None else F.coalesce(named[F.col("_s")], F.lit(default))).cast("long")


def schedule(sources: DataFrame, weights: dict[str, int], default: int) -> DataFrame:
    """One period of the EDF schedule. ``sources``: (_s), a row per source.

    Returns per slot: _s, _k (index of the source's block within the period), slot, period.
    """
    one = sources.select(F.struct("_s", _weight(weights, default).alias("w")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("sources"))
    one = one.where(F.size("sources") > 0).withColumn("period", F.expr("aggregate(sources, 0L, (a, x) -> a + x.w)"))
    member = "transform(filter(transform(sources, (x, i) -> struct(x.w as w, i as i)), x -> x.w = w), x -> x.i)"
    kinds = F.expr(f"transform(array_sort(array_distinct(transform(sources, x -> x.w))), w -> named_struct('w', w, 'members', {member}, 'm', cast(size({member}) as bigint)))")
    slots = one.withColumn("kinds", kinds).select("sources", "period", F.posexplode(F.expr(_EDF)).alias("slot", "o"))
    return slots.select(F.col("sources")[F.col("o.i")]["_s"].alias("_s"), F.col("o.k").alias("_k"), F.col("slot").cast("long").alias("slot"), "period")


def _slotted(docs: DataFrame, weights: dict[str, int], default: int, block_rows: int, told_by: str = "") -> DataFrame:
    """(_row, _i, weight, block, slot): every row with its number within its source and the slot of its block."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name == (told_by or f.name) and not re.search("map<|variant", f.dataType.simpleString())] or [F.lit(0)]
    other = F.concat(F.lit("null "), F.xxhash64(*plain).cast("string"))  # rows without an id are told apart by what they hold
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), other))
    rows = docs.select(F.col("doc_id").alias("_id"), source_key(F.col("source")).alias("_s"), key.alias("_h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    pattern = common.staged(schedule(rows.select("_s").distinct(), weights, default), "pattern")
    if pattern.count() <= BROADCAST_SLOTS:
        pattern = F.broadcast(pattern)
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    rows = common.numbered(rows, ["_s"], [F.col("_h"), F.col("_id")], bucket, "_i")
    rows = rows.withColumn("block", F.expr(f"_i div {block_rows}")).withColumn("weight", _weight(weights, default))
    rows = rows.withColumn("_p", F.expr("block div weight")).withColumn("_k", F.expr("block % weight"))
    return rows.join(pattern, ["_s", "_k"]).select("_row", "_i", "weight", "block", (F.col("slot") + F.col("_p") * F.col("period")).alias("slot"))


def _stretch(docs: DataFrame) -> Column:
    """Slots in stretches of about the square root of the rows: neither a stretch nor their number grows with all rows."""
    return F.expr(f"slot div {max(8, math.isqrt(docs.count()))}")


def mix(docs: DataFrame, weights: dict[str, int], default: int = DEFAULT_WEIGHT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row with its place in the mix: weight, block, slot and ``position`` (gapless from 0).

    A source's rows, in the order of md5(doc_id), form blocks of
    ``block_rows`` (the last may be shorter). Slots go to blocks by Pfair
    earliest-deadline-first; the schedule repeats after (sum of weights)
    slots, so one period is computed and each row's slot follows in closed
    form; positions count the rows of the slots before. While all sources last,
    each source's blocks among the first t differ from t times its share by
    less than one. A source that ends leaves its slots empty; the others keep
    their order and proportions. No row is dropped or repeated, and neither
    sources nor weights are limited; the period is computed in one task, in
    time proportional to (sum of weights) x (distinct weights).

    Reads doc_id and source; all other columns pass through, but for those
    named weight, block, slot or position, which the added ones replace. Null
    sources are one source of the default weight; rows with a null id are
    ordered by a hash of their columns, rows with a repeated one in no fixed
    order; an empty table gives no rows.
    """
    out = _slotted(docs, weights, default, block_rows)
    out = common.numbered(out, [], [F.col("slot"), F.col("_i")], _stretch(docs), "position")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED]
    return out.select(*kept, *ADDED)


def in_mixed_order(docs: DataFrame, weights: dict[str, int] = TARGET_WEIGHTS, default: int = DEFAULT_WEIGHT, per_file: int = 20_000) -> DataFrame:
    """``docs`` itself, its rows in the order of the mix: partition after partition, of about ``per_file`` rows each.

    Written as Parquet, a partition becomes a file, and ``window`` finds its number again.
    """
    whole = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stretch = _stretch(docs)
    slim = _slotted(docs.select("doc_id", "source"), weights, default, BLOCK_ROWS).groupBy(stretch.alias("_t")).agg(F.count("*").alias("n"))
    before = "coalesce(sum(n) over (order by _t rows between unbounded preceding and 1 preceding), 0)"
    files = common.staged(slim.select("_t", F.expr(f"cast({before} div {per_file} as int)").alias("_f")), "files")
    parts = (files.agg(F.max("_f")).first()[0] or 0) + 1
    placed = _slotted(whole, weights, default, BLOCK_ROWS, told_by="row").withColumn("_t", stretch).join(files, "_t")
    ordered = placed.repartitionById(parts, F.col("_f")).sortWithinPartitions("slot", "_i")
    return ordered.select(*(F.col("_row.row").getField(c).alias(c) for c in docs.columns))


def window(docs: DataFrame) -> Column | None:
    """The number of the file that a row of a written mix was read from; None for a table that isn't read from files."""
    number = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as bigint)")
    try:
        docs.select(number)
    except AnalysisException:
        return None
    return number


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, TARGET_WEIGHTS)


def _sql() -> str:
    values = ", ".join(f"('{s}', {w})" for s, w in TARGET_WEIGHTS.items())
    return f"""
WITH RECURSIVE given(s, w) AS (VALUES {values}),
n AS (SELECT coalesce(source, chr(1)) AS s, count(*) AS n FROM documents GROUP BY 1),
src AS (SELECT s, n, CAST(coalesce(w, {DEFAULT_WEIGHT}) AS BIGINT) AS w, row_number() OVER (ORDER BY s) AS i FROM n LEFT JOIN given USING (s)),
tot AS (SELECT CAST(sum(w) AS BIGINT) AS period, list(w ORDER BY i) AS ws, list(n ORDER BY i) AS ns FROM src),
edf(t, c, i) AS (
  SELECT CAST(0 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM tot
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, k: CASE WHEN k = b.i THEN x + 1 ELSE x END), b.i
  FROM (SELECT e.t, e.c, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda k: (e.c[k] * period) // ws[k] <= e.t),
            lambda k: {{'d': ((e.c[k] + 1) * period + ws[k] - 1) // ws[k], 'i': k}})) AS b
        FROM edf e, tot WHERE e.t < period)),
pat AS (SELECT e.t - 1 AS slot, src.s, e.c[e.i] - 1 AS k, list_transform(e.c, lambda x, j: CASE WHEN j = e.i THEN x - 1 ELSE x END) AS before
        FROM edf e JOIN src ON src.i = e.i WHERE e.t > 0),
r AS (SELECT doc_id, source, coalesce(source, chr(1)) AS s,
             row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS j FROM documents),
b AS (SELECT doc_id, source, s, w, j, j // {BLOCK_ROWS} AS block, (j // {BLOCK_ROWS}) // w AS p, (j // {BLOCK_ROWS}) % w AS k FROM r JOIN src USING (s))
SELECT doc_id, source, w AS weight, block, slot + p * period AS slot,
       CAST(list_sum(list_transform(range(1, len(ws) + 1), lambda x: least(ns[x], {BLOCK_ROWS} * (before[x] + p * ws[x])))) AS BIGINT) + j % {BLOCK_ROWS} AS position
FROM b JOIN pat USING (s, k), tot
"""


OP2_SQL = _sql()
