"""Shards of near equal bytes by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEY_BITS, FIRST_BITS, STEP_BITS = 60, 12, 6
#: Capacities tried between two reads of the table.
TRIES = 5


class Ranges:
    """What is known of the groups along the key order. A range covers the keys lo to lo + 2**bits - 1 and
    holds n groups of size s together, the largest of size most; with n = 1, lo is that group's key."""

    def __init__(self, found: list[tuple[int, int, int, int, int]]) -> None:
        self.all = sorted(found)
        self.ends = [0, *accumulate(r[2] for r in self.all)]

    def step(self, at: int) -> tuple[int, int]:
        """Bounds of the last group end (total size up to there) that is no larger than ``at``."""
        i = bisect_right(self.ends, at) - 1
        if i >= len(self.all) or self.ends[i] == at:
            return (min(at, self.ends[-1]),) * 2
        n, most = self.all[i][3:]
        return (self.ends[i], self.ends[i]) if n == 1 else (max(self.ends[i], at - most + 1), at)

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of where each shard ends if every one takes all that ``capacity`` allows."""
        low, high, out = 0, 0, []
        for _ in range(shards):
            low, high = self.step(low + capacity)[0], self.step(high + capacity)[1]
            out.append((low, high))
        return out

    def least(self, shards: int, side: int) -> int:
        """The smallest capacity that does for certain (side 0), or may do (side 1)."""
        low, high, total = 1, max(1, self.ends[-1]), self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards)[-1][side] >= total else (mid + 1, high)
        return low

    def unclear(self, capacity: int, shards: int) -> set[int]:
        """Ranges of several groups in which a cut of this capacity may lie; of wide bounds only both ends."""
        found: set[int] = set()
        before = (0, 0)
        for low, high in self.cuts(capacity, shards):
            if low != high:
                ends = [min(len(self.all), bisect_right(self.ends, x + capacity)) - 1 for x in before]
                found.update(i for i in ends if self.all[i][3] > 1)
            before = (low, high)
        return found


def boundaries(groups: DataFrame, shards: int) -> list[int]:
    """The keys at which shards 1, 2, ... begin, so that the largest shard is as small as can be.

    ``groups``: (k, s), one row per group, k below 2**60. The driver sees totals
    of key ranges: 2**12 at first. A few capacities between the one that may do
    and the one that does for certain are tried; the ranges in which one of
    their cuts lies, at most two per cut, are split in 2**6, and so on until the
    two capacities meet. What is read per round is at most
    2 * TRIES * (shards - 1) * 2**6 rows, however many groups there are.
    """
    def read(df: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
        by = df.groupBy(F.shiftright("k", bits).alias("p")).agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.min("k").alias("k"), F.max("s").alias("m"))
        return [(r["k"] if r["n"] == 1 else r["p"] << bits, bits, r["s"], r["n"], r["m"]) for r in by.collect()]

    ranges = Ranges(read(groups, KEY_BITS - FIRST_BITS))
    while True:
        may, does = ranges.least(shards, 1), ranges.least(shards, 0)
        tried = {may + (does - may) * i // (TRIES - 1) for i in range(TRIES)}
        split = set().union(*(ranges.unclear(c, shards) for c in tried)) if may < does else ranges.unclear(does, shards)
        if not split:
            break
        by: dict[int, list[int]] = {}
        for i in split:
            by.setdefault(ranges.all[i][1], []).append(ranges.all[i][0])
        finer = []
        for bits, lows in by.items():
            inside = [F.col("k").between(lo, lo + (1 << bits) - 1) for lo in lows]
            finer += read(groups.where(reduce(or_, inside)), max(0, bits - STEP_BITS))
        ranges = Ranges([r for i, r in enumerate(ranges.all) if i not in split] + finer)
    ends = [low for low, _ in ranges.cuts(does, shards)[:-1]]
    at = [bisect_left(ranges.ends, e) for e in ends]
    return [ranges.all[i][0] for i in at if i < len(ranges.all)]


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put every row into a shard; bytes per shard are near equal and equal texts stay together.

    Size: UTF-8 bytes of the text (null: none) plus 1. Groups of equal texts
    (null counts as empty), in the order of their SHA-256, are the atoms. A
    group at least as large as an even share of what is left takes a shard
    alone, the rest is cut at the smallest feasible shard capacity.

    Slots follow the order in which the rows are read. Reads doc_id and text,
    other columns are ignored. Null doc_ids and repeated rows are rows like any
    other. With fewer groups than shards some shards stay empty; an empty table
    gives no rows. Returns doc_id, size, text_crc32, law, shard, slot,
    grown_shard.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("k"), F.monotonically_increasing_id().alias("row"))
    rows = common.staged(rows, "sizes")
    groups = common.staged(rows.groupBy("k").agg(F.sum("size").alias("s")), "groups")
    left = groups.agg(F.sum("s").alias("s")).first()["s"] or 0
    own: list[int] = []
    top = groups.orderBy(F.desc("s"), "k").limit(shards).collect()
    while len(own) < min(len(top), shards - 1) and top[len(own)]["s"] * (shards - len(own)) >= left:
        left -= top[len(own)]["s"]
        own.append(top[len(own)]["k"])
    rest = groups.where(~F.col("k").isin(own)) if own else groups
    at = boundaries(rest, shards - len(own)) if left else []
    shard = F.lit(len(own))
    for b in at:
        shard = shard + (F.col("k") >= F.lit(b)).cast("int")
    for i, k in enumerate(own):
        shard = F.when(F.col("k") == k, i).otherwise(shard)
    part = F.shiftrightunsigned("row", 33)  # the partition that read the row, so no group is numbered in one task
    out = common.numbered(rows.withColumn("shard", shard.cast("int")), ["shard"], [F.col("row")], part, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(common.table(spark, sf_dir, "documents"))
