"""Similarity memory: hashed embeddings, upsert with a cap, recall, prior statistics, routing by example."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import suppress
from functools import reduce
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import scan
from ..sources.tablelog import COMPACT_AT, TableLog
from . import neighbours
from .vector_index import VectorIndex

#: Vector width, entries kept, neighbours, least similarity for a routing override.
DIMS, MAX_ENTRIES, NEIGHBOURS, ROUTE_LEAST = 256, 500, 5, 0.45
#: Vectors of one block of a comparison set (2 KB each).
BLOCK = neighbours.BLOCK
#: Bytes of text whose words are held at once.
EMBED_CHUNK = 1 << 20
_SPLIT = re.compile("[^a-z0-9]+")


def grams(text: str) -> list[bytes]:
    tokens = [t for t in _SPLIT.split(text.lower()) if len(t) > 1]
    return [t.encode() for t in [*tokens, *(f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False))]]


def fnv1a(words: list[bytes]) -> np.ndarray:
    """32-bit FNV-1a of every word; words of one length are hashed together."""
    out = np.zeros(len(words), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        block = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)
        h = np.full(len(at), 2166136261, np.uint32)
        for k in range(n):
            h = (h ^ block[:, k]) * np.uint32(16777619)
        out[at] = h
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hash_embed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """256 signed counts of words and word pairs, normalised; null for null. The words of up to 500 texts are hashed together, each distinct one once, and no more are held."""
    for text in (part for batch in texts for (part,) in scan.chunks(batch, size=EMBED_CHUNK, rows=500)):
        part = [grams(t) if t is not None else [] for t in text.to_pylist()]
        number = {g: i for i, g in enumerate(dict.fromkeys(chain.from_iterable(part)))}
        h = fnv1a(list(number))
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(part)), np.int64)
        row = np.repeat(np.arange(len(part)), [len(p) for p in part])
        sign = np.where(h >> 31, -1.0, 1.0)
        flat = np.bincount(row * DIMS + (h % DIMS).astype(np.int64)[ids], sign[ids], len(part) * DIMS).astype(np.float64, copy=False).reshape(-1, DIMS)  # counts of nothing are integers
        size = np.sqrt((flat**2).sum(1))
        flat /= np.where(size > 0, size, 1)[:, None]
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * DIMS)
        yield pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()), mask=pa.array(~text.is_valid().to_numpy(zero_copy_only=False)))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it is known to have at most so many rows; beyond that Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nearest(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k entries (id, vector) that are most similar to each query (query_id, vector), with either side of any size."""
    return neighbours.nearest(queries, entries, k, BLOCK)


def upsert(entries: DataFrame, cap: int = MAX_ENTRIES) -> DataFrame:
    """``entries`` (seq, id, ...), one row per write: each id keeps the place of its first write and the payload of its last; the newest ``cap`` places stay.

    Grouped by id first; what is ranked globally is one (place) number per id, cut to ``cap`` per partition before.
    """
    payload = F.struct(*(c for c in entries.columns if c not in ("seq", "id")))
    merged = entries.groupBy("id").agg(F.min("seq").alias("place"), F.max_by(payload, "seq").alias("p"))
    return merged.orderBy(F.desc("place")).limit(cap).select("place", "id", "p.*")


def recall(prompts: DataFrame, memory: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest entries of every prompt, with their rank. Reads prompts (prompt_id, vector) and memory (place, vector, ...); ties go to the earlier place."""
    near = nearest(prompts.select(F.col("prompt_id").alias("query_id"), "vector"), memory.select(F.col("place").alias("id"), "vector"), k)
    near = near.select(F.col("query_id").alias("prompt_id"), F.col("id").alias("place"), "similarity")
    order = Window.partitionBy("prompt_id").orderBy(F.round("similarity", 12).desc(), "place")
    return near.withColumn("rank", F.row_number().over(order)).join(sized(memory.drop("vector"), MAX_ENTRIES), "place")


def priors(near: DataFrame) -> DataFrame:
    """Largest similarity to a failed and to an accepted neighbour, within 0 and 1."""
    failed = (F.col("decision") != "allow") | (F.col("n_findings") > 0)
    top = lambda test: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(F.when(test, F.col("similarity")).otherwise(0.0))))
    return near.groupBy("prompt_id").agg(top(failed).alias("prior_failure_similarity"), top(F.col("accepted")).alias("prior_win_similarity"))


def top_similar(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top k of a set of vectors (``corpus``: id, vector) for each query (query_id, vector) by cosine."""
    near = nearest(queries, corpus, k)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "similarity", "rank")


ENTRY = "place long, id string, preview string, vector array<double>, composite double, accepted boolean, decision string, n_findings int, token_reduction double"
_ENTRY_NAMES = [c.split()[0] for c in ENTRY.split(", ")]
PAYLOAD = ("preview", "vector", "composite", "accepted", "decision", "n_findings", "token_reduction")
#: An evaluation accepts its winner from this accuracy on, and so much of a prompt is its preview. Fixed values.
ACCEPT_ACCURACY, PREVIEW = 0.9, 160


def entries(outcomes: DataFrame) -> DataFrame:
    """Memory writes from outcomes (seq, id, text, composite, accepted, decision, n_findings, token_reduction); without an id the text's hash is it."""
    key = F.coalesce(F.when(F.col("id") != "", F.col("id")), F.sha2("text", 256))
    kept = ("composite", "accepted", "decision", "n_findings", "token_reduction")
    return outcomes.select("seq", key.alias("id"), F.substring("text", 1, PREVIEW).alias("preview"), hash_embed("text").alias("vector"), *kept)


def evaluated(wins: DataFrame) -> DataFrame:
    """Outcomes of an evaluation (seq, id, text, composite, accuracy, decision, n_findings, token_reduction): under the same id they take the place of what the optimizer wrote."""
    return wins.withColumn("accepted", F.col("accuracy") >= ACCEPT_ACCURACY)


class Backend(Protocol):
    """What a similarity memory does. Any store that does it can stand in for the table."""

    def upsert(self, writes: DataFrame) -> None: ...
    def query(self, prompts: DataFrame, k: int = NEIGHBOURS) -> DataFrame: ...
    def all(self) -> DataFrame: ...
    def clear(self) -> None: ...


class TableBackend:
    """A memory in a folder, as a log of changes.

    A write adds a part with what it changes: new payloads of the ids that are
    there, and the newest ``cap`` ids that aren't, numbered on from the last
    place. Reading merges the parts: an id keeps the place of its first write
    and the payload of its last one. The newest ``cap`` places stay; each commit
    notes the least of them, so an id that had to go and comes again is new,
    whenever the parts are merged for good. Writers don't wait for each other:
    who is second works out its change again. A batch of a writer that runs
    twice is there once.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int | None = MAX_ENTRIES) -> None:
        self.spark, self.cap = spark, cap
        self.log = TableLog(spark, path, ENTRY)

    def _merged(self, manifest: dict) -> DataFrame:
        """All ids of the parts. ``place`` of a part's rows counts from its ``first``; ``floor`` is the least place that stayed before it came."""
        parts = manifest["parts"]
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        rows = [self.log.read_part(p).withColumn("place", F.col("place") + p["first"]).withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
        if len(rows) == 1:
            return rows[0].drop("part")
        writes = F.array_sort(F.collect_list(F.struct("part", "place", F.struct(*PAYLOAD).alias("p"))))
        floors = F.array(*(F.lit(p["floor"]).cast("long") for p in parts))
        none = F.lit(None).cast(f"struct<place:bigint,p:struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in rows[0].schema if f.name in PAYLOAD)}>>")

        def take(kept, write):
            stays = kept["place"] >= F.get(floors, write["part"])
            return F.struct(F.when(stays, kept["place"]).otherwise(write["place"]).alias("place"), write["p"].alias("p"))

        # at most one write per id and part
        merged = reduce(DataFrame.unionByName, rows).groupBy("id").agg(writes.alias("w")).withColumn("x", F.aggregate("w", none, take))
        return merged.select("x.place", "id", "x.p.*")

    def all(self, manifest: dict | None = None) -> DataFrame:
        """The entries as of the last manifest (or of a given one)."""
        m = manifest or self.log.last()
        return self._merged(m).where(F.col("place") >= m["notes"].get("floor", 0))

    def upsert(self, writes: DataFrame, number: int | None = None, writer: str = "") -> None:
        """Merge writes (seq, id, ...): of one id the first ``seq`` is its place, the last its payload. ``number``: the writer's batch, by default its next; one that is there already changes nothing."""
        merged = writes.groupBy("id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*PAYLOAD), "seq").alias("p"))

        def change(m: dict) -> dict:
            if number is None:
                m["writers"][writer] = m["writers"].get(writer, -1) + 1
            rows, span = self._numbered(merged, m)
            if rows is None:
                return {**m, "notes": {"next": 0, "floor": 0, **m["notes"]}}
            first, floor = m["notes"].get("next", 0), m["notes"].get("floor", 0)
            m["parts"].append({"folder": self.log.write_part(rows.select("place", "id", "p.*").select(*_ENTRY_NAMES)), "first": first, "floor": floor})
            if span is None:
                span = (self.log.read_part(m["parts"][-1]).agg(F.max("place")).first()[0] or 0) + 1
            m["notes"] = {**m["notes"], "next": first + span, "floor": floor}
            if self.cap is not None:
                newest = self.all(m).orderBy(F.desc("place")).limit(self.cap).agg(F.count("*").alias("n"), F.min("place").alias("least")).first()
                if newest["n"] == self.cap:
                    m["notes"]["floor"] = newest["least"]
            return m

        if len(self.log.commit(change, writer, number)["parts"]) > COMPACT_AT:
            self.compact()

    def _numbered(self, merged: DataFrame, m: dict) -> tuple[DataFrame | None, int | None]:
        """What a write (id, seq, p) changes, with ``place`` counted from 0 in the order of ``seq``, and how many places it takes (None: those that its part has)."""
        ids = merged.count()
        if not ids:
            return None, None
        live = F.broadcast(self.all(m).select("id"))  # at most ``cap``
        new = merged.join(live, "id", "left_anti").orderBy(F.desc("seq")).limit(self.cap)
        rows = merged.join(live, "id", "left_semi").unionByName(new)
        # twice ``cap`` rows at most; numbered from the end, as ids left out are the oldest
        return rows.withColumn("place", F.lit(ids) - F.row_number().over(Window.orderBy(F.desc("seq")))).coalesce(1), ids

    def compact(self) -> None:
        """One part with what stays, then drop what nothing needs any more."""

        def change(m: dict) -> dict:
            rows = self.all(m).select(*_ENTRY_NAMES)
            return {**m, "parts": [{"folder": self.log.write_part(rows if self.cap is None else rows.coalesce(1)), "first": 0, "floor": 0}]}

        self.log.commit(change)
        self.log.vacuum()

    def query(self, prompts: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        return recall(prompts, self.all(), k)

    def clear(self) -> None:
        self.log.commit(lambda m: {**m, "parts": [], "notes": {**m["notes"], "floor": m["notes"].get("next", 0), "cleared": m["number"] + 1}})

    def size(self) -> int:
        return self.all().count()


class IndexedBackend(TableBackend):
    """The table with a vector index beside it, for memories of any number of entries: nothing leaves by its place, and recall probes the index.

    The index is made with the first write; an entry's place is its id there. A write commits to the table alone. What
    the index hasn't seen is added before the next recall, known by the number of the last manifest that it has taken
    in, so a writer that dies between the two loses nothing.
    """

    def __init__(self, spark: SparkSession, path: str, recall: float = 0.95) -> None:
        super().__init__(spark, path, cap=None)
        self.least_recall = recall
        self.index = VectorIndex(spark, f"{path.rstrip('/')}/index")

    def _numbered(self, merged: DataFrame, m: dict) -> tuple[DataFrame | None, int | None]:
        """Places with gaps, in the order of ``seq``: partitions follow each other, and rows within them."""
        if merged.isEmpty():
            return None, None
        return merged.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("place", F.monotonically_increasing_id()), None

    def _indexed(self) -> bool:
        """Bring the index up to the table; False while there is nothing in it."""
        m, done = self.log.last(), self.index.log.last()
        seen = done["writers"].get("table", -1)
        if seen < m["notes"].get("cleared", -1) and done["parts"]:
            done = self.index.log.commit(lambda i: {**i, "parts": []}, "table", m["notes"]["cleared"])
        recent = [p for p in m["parts"] if p["number"] > seen]
        if recent:
            ids = reduce(DataFrame.unionByName, [self.log.read_part(p).select("id") for p in recent]).distinct()
            now = self.all(m).join(ids, "id", "left_semi").where("vector is not null").select(F.col("place").alias("id"), "vector")
            if done["number"] < 0:
                if now.isEmpty():
                    return False
                with suppress(FileExistsError):  # another reader's
                    VectorIndex.build(self.spark, self.index.path, now, recall=self.least_recall)
            self.index.add(now, writer="table", batch=m["number"])
        return bool(m["parts"]) and self.index.log.last()["number"] >= 0

    def query(self, prompts: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        """As the table's, but similarities below 0 count as 0."""
        if not self._indexed():
            return recall(prompts, self.all(), k)
        near = self.index.search(prompts.select(F.col("prompt_id").alias("query_id"), "vector"), k)
        near = near.select(F.col("query_id").alias("prompt_id"), F.col("id").alias("place"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("similarity"), "rank")
        return near.join(self.all().drop("vector"), "place")


def exemplars(spark, learned: str | None = None) -> DataFrame:
    """The seed exemplars with their vectors, and those in the table at ``learned``."""
    if learned is not None:
        return exemplars(spark).unionByName(spark.read.schema("tier string, name string, vector array<double>").parquet(learned))
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{n}', '{x}')" for t, n, x in L.ROUTE_EXEMPLARS) + " AS x(tier, name, text)")
    return rows.withColumn("vector", hash_embed("text")).drop("text")


def reinforce(known: DataFrame, prompts: DataFrame) -> DataFrame:
    """Exemplars with those of (text, tier, name) added."""
    return known.unionByName(prompts.select("tier", "name", hash_embed("text").alias("vector")))


def learn_route(prompts: DataFrame, path: str) -> None:
    """Append exemplars (tier, name, text) to the table at ``path``."""
    prompts.select("tier", "name", hash_embed("text").alias("vector")).write.mode("append").parquet(path)


def refine_route(prompts: DataFrame, known: DataFrame) -> DataFrame:
    """``prompts`` (prompt_id, tier, vector): the nearest exemplar's tier if it is near enough, else the own one; ties to the first by name and tier."""
    listed = known.withColumn("id", F.row_number().over(Window.orderBy("name", "tier")).cast("long"))  # exemplars are few
    near = nearest(prompts.select(F.col("prompt_id").alias("query_id"), "vector"), listed, 1)
    near = near.join(sized(listed.select("id", F.col("name").alias("exemplar"), F.col("tier").alias("_tier")), BLOCK), "id").drop("id")
    best = prompts.select("prompt_id", "tier").join(near.withColumnRenamed("query_id", "prompt_id"), "prompt_id", "left")
    sure = F.coalesce(F.col("similarity") >= ROUTE_LEAST, F.lit(False))
    return best.select("prompt_id", F.when(sure, F.col("_tier")).otherwise(F.col("tier")).alias("tier"), "exemplar", "similarity", sure.alias("overridden"))
