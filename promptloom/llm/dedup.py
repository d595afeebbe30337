"""Exact dedup with a minimal perfect hash over historical distinct digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: What counts as white space: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Digests of one shard of the index, and rows looked up by one task, at most about so many.
SHARD_DIGESTS, LOOKUP_ROWS = 50_000, 200_000
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _slot_hash(a: np.ndarray, level: int) -> np.ndarray:
    h = a ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit arrays.

    At each level a key whose bit no other key shares is settled there, the
    rest go on; a key's slot is the number of set bits before its own, so n
    keys fill the slots 0 to n-1. What is left after the last level (never
    seen with distinct keys) is kept in a sorted list.
    """

    LEVELS = 64

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray) -> None:
        self.bits, self.rest, self.base = bits, rest, 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for alone in bits:
            self.levels.append((alone, self.base + np.cumsum(alone) - alone))
            self.base += int(alone.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        for level in range(cls.LEVELS):
            if not len(left):
                break
            width = 8 * max(1, len(left) // 4 + 1)
            at = (_slot_hash(left, level) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def packed(self) -> tuple[list[bytes], bytes]:
        """The bit arrays and the rest, as the index keeps them."""
        return [np.packbits(b).tobytes() for b in self.bits], self.rest.tobytes()

    @classmethod
    def unpacked(cls, bits: list[bytes], rest: bytes) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in bits], np.frombuffer(rest, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 if it certainly is no member. A non-member may get any slot."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (alone, ranks) in enumerate(self.levels):
            at = (_slot_hash(keys[todo], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.base + at[same]
        return out


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 32)


def _keys(digests: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each digest."""
    return np.ascontiguousarray(digests[:, at : at + 8]).view(">u8").ravel().astype(np.uint64)


#: A row per shard: the hash's bit arrays; by slot, the full digests and the winners' locators.
INDEX_SCHEMA = "shard long, at int, bits array<binary>, rest binary, digests binary, keep_id array<long>, keep_chars array<long>, seen array<long>"


def build_index(winners: DataFrame, shards: int) -> DataFrame:
    """``winners``: one row per digest (digest, keep_id, keep_chars, seen). Returns the index of the minimal perfect hashes.

    The key is the first of three eight-byte parts of the digests in which those of the shard differ.
    """

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        every = _matrix(pdf["digest"])
        at = next((i for i in (8, 16, 24) if len(np.unique(_keys(every, i))) == len(every)), None)
        if at is None:
            raise ValueError("a shard's digests share all their parts")
        table = PerfectHash.build(_keys(every, at))
        order = np.argsort(table.slots(_keys(every, at)))
        bits, rest = table.packed()
        kept = [[None if pd.isna(x) else int(x) for x in pdf[c].to_numpy(object)[order]] for c in ("keep_id", "keep_chars", "seen")]
        return pd.DataFrame({"shard": [key[0]], "at": [at], "bits": [bits], "rest": [rest], "digests": [every[order].tobytes()], "keep_id": [kept[0]], "keep_chars": [kept[1]], "seen": [kept[2]]})

    sharded = winners.withColumn("shard", shard_of(F.col("digest"), shards))
    return sharded.groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def shard_of(digest: Column, shards: int) -> Column:
    """The shard by the first 60 bits of the digest."""
    return F.conv(F.substring(F.hex(digest), 1, 15), 16, 10).cast("long") % F.lit(shards)


def look_up(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """``rows`` (with digest) with the locator of their digest, null for nonmembers.

    A shard's index row meets the rows in one task; a shard that has many
    rows (a large group of copies) is split over salts, each with a copy of
    the shard's bounded index.
    """
    names = ("keep_id", "keep_chars", "seen")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    load = rows.groupBy(shard_of(F.col("digest"), shards).alias("shard")).agg(F.count("*").alias("s"))
    weights = load.select("shard", F.ceil(F.col("s") / LOOKUP_ROWS).cast("long").alias("parts")).where("parts > 1")

    def find(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns=["shard", "salt"])
        if not len(right) or not len(left):
            return left.assign(**{n: np.full(len(left), None, object) for n in names})
        row = right.iloc[0]
        wanted = _matrix(left["digest"])
        slots = PerfectHash.unpacked(list(row["bits"]), row["rest"]).slots(_keys(wanted, int(row["at"])))
        kept = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        same = (slots >= 0) & (kept[np.maximum(slots, 0)] == wanted).all(1)  # the byte check
        found = {n: pd.array(np.array(row[n], object)[np.where(same, slots, 0)], "Int64") for n in names}
        for column in found.values():
            column[~same] = pd.NA
        return left.assign(**found)

    one = F.lit(1).cast("long")
    salted = rows.withColumn("shard", shard_of(F.col("digest"), shards)).withColumn("_n", F.monotonically_increasing_id()).join(weights, "shard", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("_n"), F.coalesce(F.col("parts"), one))).drop("parts", "_n")
    copies = index.join(weights, "shard", "left").withColumn("salt", F.explode(F.sequence(one - 1, F.coalesce(F.col("parts"), one) - 1))).drop("parts")
    return salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(find, schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, chars, digest) of every row."""
    return docs.select(F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row with the most characters, then the smallest id, and how many rows there are."""
    best = F.max(F.struct("chars", (-F.col("row_id")).alias("neg")))
    own = rows.groupBy("digest").agg(best.alias("b"), F.count("*").alias("seen"))
    return own.select("digest", (-F.col("b.neg")).alias("keep_id"), F.col("b.chars").alias("keep_chars"), "seen")


def _indexed(winners: DataFrame, tag: str) -> tuple[DataFrame, int]:
    shards = max(1, -(-winners.count() // SHARD_DIGESTS))
    return common.staged(build_index(winners, shards), tag), shards


def exact_groups(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Groups of equal texts. ``docs``: doc_id long, text string; other columns are ignored.

    Texts are equal when identical without white space. ``history`` is a
    table of earlier corpora (digest, keep_id, keep_chars, seen). Its distinct
    digests go into a minimal perfect hash, whose slots hold the full digest
    and the winner's locator. A row whose digest is found there, byte by byte,
    joins that group; nonmembers are grouped among themselves. The row with the
    most code points, then the smallest doc_id, is kept, historical winners
    included. A second hash, over the groups that then hold, gives every row its
    winner.

    Without a history the first half of the rows, by a hash of doc_id, is the
    history of the second.

    Null or empty texts form one group. A null doc_id is never chosen while
    another row of its group with as many characters has one. Repeated rows
    count each; of rows with the winner's doc_id, kept is true for all. An
    empty table gives no rows. Returns doc_id, keep_id, group_size, kept,
    text_sha256.
    """
    rows = common.staged(digests(docs).withColumnRenamed("doc_id", "row_id"), "digests")
    first = F.pmod(F.xxhash64("row_id"), F.lit(2)) == 0
    batch = rows.where(~first) if history is None else rows
    past = _winners(rows.where(first)) if history is None else history.select("digest", "keep_id", "keep_chars", "seen")
    past = common.staged(past, "winners")
    index, shards = _indexed(past, "index")
    found = common.staged(look_up(batch, index, shards), "found")
    again = _winners(found.where("seen is not null")).toDF("digest", "new_id", "new_chars", "more")
    known = past.join(again, "digest", "left" if history is None else "inner")
    better = (F.col("new_chars") > F.col("keep_chars")) | ((F.col("new_chars") == F.col("keep_chars")) & (F.col("keep_id").isNull() | (F.col("new_id") < F.col("keep_id"))))
    known = known.select(
        "digest", F.when(better, F.col("new_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.greatest("keep_chars", "new_chars").alias("keep_chars"), (F.col("seen") + F.coalesce("more", F.lit(0))).alias("seen"),
    )
    groups = common.staged(known.unionByName(_winners(found.where("seen is null").drop("keep_id", "keep_chars", "seen"))), "groups")
    index, shards = _indexed(groups, "index")
    return look_up(rows, index, shards).select(
        F.col("row_id").alias("doc_id"), "keep_id", F.col("seen").alias("group_size"),
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that their group keeps, one of each group; columns unchanged."""
    groups = common.staged(exact_groups(docs), "groups")
    docs = docs.select(F.struct("*").alias("row"))  # names of any other columns can't clash
    digest = F.sha2(normalised(F.col("row.text")), 256)
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"))
    left = docs.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_gone_id")) & (digest == F.col("_gone_sha")), "left_anti")
    twice = common.staged(groups.where("kept").groupBy("text_sha256").count().where("count > 1").select(F.col("text_sha256").alias("_twice")), "twice")
    if twice.isEmpty():
        return left.select("row.*")
    rows = left.withColumn("_sha", digest).join(twice, F.col("_sha") == F.col("_twice"), "left")
    return rows.where("_twice is null").unionByName(rows.where("_twice is not null").dropDuplicates(["_twice"])).select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
"""
