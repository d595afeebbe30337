"""Shared pieces of the training-data operators: the shared folder, staged tables,
gapless numbering and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or the one its context was given.

    Only in local mode (tests) a temporary folder takes its place where neither is set.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not base:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="promptloom-")
            context.setCheckpointDir(base)
        _SCRATCH[app] = f"{base.rstrip('/')}/promptloom-{app}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session has ended; its scratch folder may stay
        pass


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a staged table that no plan needs any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished plans: Spark removes them once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str, total: Column | None = None) -> DataFrame:
    """Add ``name``: a gapless number from 0 within ``groups``, by ``bucket`` and then ``order``.

    With ``total`` the number is the sum of that column over the rows before.
    No group is sorted in one task: each (group, bucket) is numbered alone and
    a small table of bucket totals gives the offsets. ``bucket`` must not
    decrease along the wanted order and must spread the rows.
    """
    amount = F.lit(1).cast("long") if total is None else total.cast("long")
    rows = df.withColumn("_b", bucket).withColumn("_n", amount)
    keys = [f"_g{i}" for i in range(len(groups))]
    for k, g in zip(keys, groups, strict=True):
        rows = rows.withColumn(k, F.coalesce(F.col(g).cast("string"), F.lit("\0null")))
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long"))).drop("_t")
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    if total is None:
        rows = rows.withColumn("_r", (F.row_number().over(within) - 1).cast("long"))
    else:
        prior = within.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_r", F.coalesce(F.sum("_n").over(prior), F.lit(0).cast("long")))
    out = rows.join(sums, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_r"))
    return out.drop(*keys, "_b", "_n", "_r", "_o")


#: A key with more than this share of all rows counts as hot; there are fewer than its inverse of them.
HOT_SHARE = 1 / 1000


def join_by_key(rows: DataFrame, one: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``one`` (a row per key) that has their key; ``how``: inner or left.

    ``weight``: a column of ``one``, how many rows have the key. Keys above
    ``HOT_SHARE`` of their sum, fewer than 1 / HOT_SHARE by that very bound, are
    broadcast, so no task gets all rows of a hot key. Both tables are staged ones.
    """
    total = one.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(weight) > total * HOT_SHARE))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(one, key, how))


#: Bits of a filter; it only saves rows a shuffle, so its size affects speed and never the result.
FILTER_BITS = 24


def may_have(rows: DataFrame, key: list[str], keys: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false only where ``keys``, a table of columns like ``key``, surely lacks the row's.

    ``keys`` goes into FILTER_BITS bits by its hash, in at most 2**(FILTER_BITS - 6)
    rows of 64, which are broadcast whatever its size: rows stay where they are.
    Nulls are values like any other.
    """

    def at(names: list[str]) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*names), 64 - FILTER_BITS)

    bits = keys.select(at(keys.columns).alias("s")).groupBy(F.expr("s div 64").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("_bits"))
    rows = rows.withColumn("_s", at(key))
    rows = rows.join(F.broadcast(bits), F.expr("_s div 64") == F.col("_w"), "left")
    return rows.withColumn("_may", F.expr("coalesce((shiftrightunsigned(_bits, cast(_s % 64 as int)) & 1) = 1, false)")).drop("_s", "_w", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges``: two long columns ``u`` and ``v``. Returns ``(node, component)`` for
    every node of an edge; ``component`` is the smallest node it can reach. Each
    round is a grouped minimum and an equi join on the edge list, which shrinks
    towards one row per node, until nothing changes; a hub's edges are not
    gathered in one task. Nothing is collected but a count and a sum per round,
    and a round's tables go when the next one is written.
    """
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("d")), "cc-low")
        large = join_by_key(both, low, "u", "d").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = staged(small.select("x.u", "x.v").where("u <> v").distinct(), "cc")
        forget(low)
        forget(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == last:
            break
        last = (now["n"], now["h"])
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
