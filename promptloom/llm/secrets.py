"""Secret scans with an incremental blob ledger."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import common


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hint`` is a Java pattern that every text with a match matches;
    ``measured`` is the group whose length must reach ``least``. A change asks for a new ``version``."""

    kind: str
    version: int
    pattern: str
    flags: int
    measured: int
    least: int
    hint: str


#: Fixed patterns, in the order in which kinds are listed.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", re.ASCII, 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]+", re.ASCII, 0, 24, r"[0-9a-f]{24}"),
)
LEDGER_SCHEMA = "blob string, kind string, version int, starts array<int>, ends array<int>"


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of the leftmost, non-overlapping matches that are long enough; code points, end exclusive."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.measured) - m.start(rule.measured) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    by = {(r.kind, r.version): (r, re.compile(r.pattern, r.flags)) for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text, todo in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for pair in todo:
                    spans = find(*by[pair["kind"], pair["version"]], text)
                    rows.append((blob, pair["kind"], pair["version"], [a for a, _ in spans], [b for _, b in spans]))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["blob", "kind", "version", "starts", "ends"])

    return run


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """What the ledger at ``path`` says, one row per key even if an append ran twice; None before the first append."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path).dropDuplicates(["blob", "kind", "version"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def versions(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One pass over (doc_id, text): every row's content address ``blob``, which rules' hints its text has, and,
    only for those with a hint, the text. Written once, so later reads agree on ``row``."""
    text = F.coalesce("text", F.lit(""))
    hinted = F.filter(F.array(*(F.when(F.col("text").rlike(r.hint), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))) for r in rules)), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(text, 256).alias("blob"), hinted.alias("hinted"), text.alias("text"))
    return common.staged(rows.withColumn("text", F.when(F.size("hinted") > 0, F.col("text"))), "versions")


def scan_new(noted: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` doesn't know and append it there; returns the rows appended.

    ``noted``: what ``versions`` gives for the same rules. The ledger has a row
    per (blob, kind, rule version). Of the rows that share an unseen blob one
    is scanned, by the rule versions that are missing. Texts without a rule's
    hint are entered as scanned without leaving the JVM; only the rest, once
    each, go to the matcher.
    """
    spark = noted.sparkSession
    all_rules = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    blobs = noted.groupBy("blob").agg(F.min(F.struct("row", "hinted")).alias("f")).select("blob", "f.row", "f.hinted")
    known = ledger(spark, path)
    if known is None:
        todo = blobs.withColumn("todo", all_rules)
    else:
        had = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("had"))
        todo = blobs.join(had, "blob", "left").withColumn("todo", F.when(F.col("had").isNull(), all_rules).otherwise(F.array_except(all_rules, "had")))
    todo = common.staged(todo.where(F.size("todo") > 0).select("blob", "row", F.array_except("todo", "hinted").alias("clean"), F.array_intersect("todo", "hinted").alias("todo")), "todo")
    none = F.array().cast("array<int>")
    clean = todo.select("blob", F.explode("clean").alias("x")).select("blob", "x.kind", "x.version", none.alias("starts"), none.alias("ends"))
    texts = noted.where("text is not null").select("row", "text").join(todo.where(F.size("todo") > 0).select("row", "blob", "todo"), "row")
    found = texts.select("blob", "text", "todo").mapInArrow(_scan(rules), LEDGER_SCHEMA)
    fresh = common.staged(clean.union(found), "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh


def find_secrets(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Secrets of every whole text, through the blob ledger at ``path`` (default: a new one in the shared folder).

    ``docs``: doc_id, text; other columns are ignored. Null texts count as
    empty and have no secrets. Null or repeated doc_ids are rows like any
    other; rows with equal texts share one scan. An empty table gives no rows.
    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans; the ledger
    adds no spans of its own, so ``spans`` is what ``base_sha256`` digests.
    """
    spark = docs.sparkSession
    path = path or common.scratch_path(spark, "ledger")
    noted = versions(docs, rules)
    scan_new(noted, path, rules)
    now = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    listed = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    spans = F.expr("transform(arrays_zip(starts, ends), x -> struct(x.starts as s, at as at, x.ends as e, kind as kind))")
    hits = ledger(spark, path).where((F.size("starts") > 0) & F.array_contains(now, F.struct(F.col("kind"), F.col("version"))))
    hits = hits.withColumn("at", listed[F.col("kind")]).withColumn("x", spans)
    one = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))  # a blob's rules: few rows
    one = one.withColumn("spans", F.expr("array_join(transform(x, y -> concat(y.kind, ':', y.s, ':', y.e)), ',')"))
    counts = [F.expr(f"cast(size(filter(x, y -> y.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    seen = noted.where(F.size("hinted") > 0).select("doc_id", "blob")
    one = one.select("blob", "spans", *counts).join(seen.groupBy("blob").agg(F.count("*").alias("rows")), "blob")
    rows = common.join_by_key(seen, common.staged(one, "found"), "blob", "rows", "left")
    rows = rows.unionByName(noted.where(F.size("hinted") == 0).select("doc_id", "blob"), allowMissingColumns=True)  # nothing to find in them
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(F.coalesce("spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """The result for one text, without Spark."""
    found = sorted((a, i, b) for i, r in enumerate(RULES) for a, b in find(r, re.compile(r.pattern, r.flags), text or ""))
    joined = ",".join(f"{RULES[i].kind}:{a}:{b}" for a, i, b in found)
    return (*(sum(i == k for _, i, _ in found) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), joined)


def _sql() -> str:
    patterns = {"assign": "(?i)" + RULES[0].pattern, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}  # runs are maximal, so shorter ones may be left out
    parts = []
    for i, r in enumerate(RULES):
        p = patterns[r.kind].replace("'", "''")
        measured = f"length(regexp_extract(m, '{p}', {r.measured}))"
        parts.append(f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS ord, list_transform(list_filter(list_transform(range(1, len(m) + 1),
            lambda j: {{'s': list_sum(list_transform(s[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0), 'm': m[j]}}),
            lambda x: {measured.replace('(m,', '(x.m,')} >= {r.least}), lambda x: {{'s': x.s, 'e': x.s + length(x.m)}}) AS spans
          FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS s FROM d)""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(parts)}),
f AS (SELECT doc_id, kind, ord, unnest(spans) AS x FROM a),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
             string_agg(kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT), ',' ORDER BY x.s, ord) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP3_SQL = _sql()
