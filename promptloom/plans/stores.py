"""Queries of tables that change, of the vector index and of the frontier of large groups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import CHECK, SPARK, apply, ctes
from ..operators import compare, memory, score
from ..operators.vector_index import VectorIndex
from ..sources import library
from ..sources.shared import new_path
from ..sources.tablelog import SavedPrompts
from .corpus import prompt_corpus
from .registry import _VECTORS_SQL, CORPUS, _query, _scored, _vectors, _with_schema_score

#: Parts in which the tables arrive, and neighbours that are asked for.
BATCHES, K = 8, 5


def _part(number: str, of: str) -> str:
    """Which of BATCHES parts, in order, a row with this number among ``of`` belongs to."""
    return f"({number} * {BATCHES} // {of})"


# ---- memory: events as decisions that arrive in batches; ids that had to go and come again are new

_LAST = "(SELECT max(event_id) + 1 FROM events)"


@_query("memory_log", f"""WITH RECURSIVE w AS (SELECT CAST((event_id * 7919) % 1500 AS VARCHAR) AS id, event_id AS seq, event_type AS decision, value AS composite, CAST({_part('event_id', _LAST)} AS INTEGER) AS b FROM events),
d AS (SELECT b, id, min(seq) AS place, arg_max(decision, seq) AS decision, arg_max(composite, seq) AS composite FROM w GROUP BY b, id),
m AS (SELECT -1 AS b, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS DOUBLE) AS composite
  UNION ALL SELECT * FROM (SELECT n.b, x.id, min(x.place) AS place, arg_max(x.decision, x.k) AS decision, arg_max(x.composite, x.k) AS composite
    FROM (SELECT b + 1 AS nb, id, place, decision, composite, 0 AS k FROM m WHERE id IS NOT NULL UNION ALL SELECT d.b, d.id, d.place, d.decision, d.composite, 1 FROM d WHERE d.b = (SELECT max(b) + 1 FROM m)) x(b, id, place, decision, composite, k)
      JOIN (SELECT max(b) + 1 AS b FROM m) n ON n.b = x.b AND n.b < {BATCHES} GROUP BY n.b, x.id
    QUALIFY row_number() OVER (ORDER BY min(x.place) DESC) <= {memory.MAX_ENTRIES}))
SELECT id, CAST(row_number() OVER (ORDER BY place) AS BIGINT) AS nth, decision, composite FROM m WHERE b = {BATCHES - 1}""")
def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory after all events came in batches, each one a change of its own, in the order of its places."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] + 1
    none = "cast(null as string) as preview", "cast(null as array<double>) as vector"
    writes = events.selectExpr("event_id as seq", "cast((event_id * 7919) % 1500 as string) as id", *none, "value as composite", "true as accepted", "event_type as decision", "0 as n_findings", "0D as token_reduction", f"event_id * {BATCHES} div {last} as batch")
    known = memory.TableBackend(spark, new_path(spark, "memory"))
    for b in range(BATCHES):
        known.upsert(writes.where(F.col("batch") == b), b, writer="events")
    rows = known.all()  # ``cap`` rows at most
    return rows.selectExpr("id", "cast(row_number() over (order by place) as bigint) as nth", "decision", "composite")


@_query("saved_prompts", f"""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS content FROM customer WHERE c_custkey NOT IN (7, 11) AND c_nationkey <> 3 OR CAST({_part('c_custkey', '(SELECT max(c_custkey) + 1 FROM customer)')} AS INTEGER) = {BATCHES - 1}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'again ' || c_name, c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_acctbal > 5000 AND CAST({_part('c_custkey', '(SELECT max(c_custkey) + 1 FROM customer)')} AS INTEGER) < {BATCHES - 1}""")
def saved_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as saved prompts that come in batches; before the last one those of a nation are taken out, and some of them saved again."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    last = customers.agg(F.max("c_custkey")).first()[0] + 1
    rows = customers.selectExpr("cast(c_custkey as string) as id", "c_name as title", "c_mktsegment as content", "c_nationkey", "c_acctbal", f"c_custkey * {BATCHES} div {last} as batch")
    store = SavedPrompts(spark, new_path(spark, "saved"), "id string, title string, content string")
    for b in range(BATCHES - 1):
        store.save(rows.where(F.col("batch") == b), "customers", b)
    store.delete("7", "11")
    gone = rows.where((F.col("c_nationkey") == 3) & (F.col("batch") < BATCHES - 1))
    store.replace(lambda now: now.join(gone.select("id"), "id", "left_anti"))
    store.save(gone.where("c_acctbal > 5000").withColumn("title", F.concat(F.lit("again "), "title")), "again", 0)
    store.save(rows.where(F.col("batch") == BATCHES - 1), "customers", BATCHES - 1)
    store.compact()
    return store.all()


# ---- the vector index over all vectors: the first half when it is built, the rest added, some of them twice


def _index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    v = _vectors(spark, sf_dir).selectExpr("vec_id as id", "vector")
    middle = v.agg(F.max("id")).first()[0] // 2
    index = VectorIndex.build(spark, new_path(spark, "index"), v.where(F.col("id") <= middle), K)
    index.add(v.where(F.col("id") > middle), "vectors", 0)
    index.add(v.where(F.col("id") > middle), "vectors", 0)  # the same batch again
    return index, v.selectExpr("id as query_id", "vector")


@_query("vector_index_exact", f"WITH {_VECTORS_SQL}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.vector, b.vector), 5) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.vector, b.vector) DESC, b.vec_id) AS rank FROM v a, v b) SELECT query_id, CAST(rank AS INTEGER) AS rank, similarity FROM s WHERE rank <= {K}")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarities of every vector's nearest ones, by all lists of the index. Vectors are kept with single precision."""
    index, queries = _index(spark, sf_dir)
    return index.exact(queries, K).select("query_id", "rank", F.round("similarity", 5).alias("similarity"))


@_query("vector_index_recall")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of every vector's nearest ones the probed lists give."""
    index, queries = _index(spark, sf_dir)
    return index.recall(queries, K).select("query_id", "found", "n", "recall")


# ---- the frontier of all prompts of a task, by their real scores


@_query("pareto_tasks", f"WITH {ctes(CORPUS, _scored(CHECK))} SELECT prompt_id, task_type, NOT EXISTS (SELECT 1 FROM result o WHERE o.task_type IS NOT DISTINCT FROM r.task_type AND {score.dominates('o', 'r')}) AS on_frontier FROM result r")
def pareto_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which prompts of the corpus no other prompt of the same task beats."""
    scored = apply(_with_schema_score(spark, sf_dir), _scored(SPARK))
    return score.pareto(scored.select("prompt_id", "task_type", *score.NAMES), "task_type").select("prompt_id", "task_type", "on_frontier")


# ---- titles in a reader's order: letters first, small ones before capital ones where nothing else differs

_TITLE = "CASE o_orderkey % 3 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN upper(o_orderpriority) ELSE o_orderpriority END"
_CASES = "translate(title, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"


@_query("templates_by_title", f"SELECT title, n, CAST(row_number() OVER (ORDER BY lower(title), {_CASES}) AS INTEGER) AS place FROM (SELECT split_part({_TITLE}, '-', 2) AS title, count(*) AS n FROM orders GROUP BY ALL) WHERE title <> ''")
def templates_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities in mixed case as titles: the distinct ones, which are few, with their places."""
    title = F.split_part(F.expr(_TITLE.lower()), F.lit("-"), F.lit(2))
    counts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(title.alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("n"))
    return counts.select("title", "n", F.row_number().over(Window.orderBy(library.locale())).alias("place"))


# ---- a script of edits played both ways gives both texts

_EDITED = "replace(replace(text, 'must', 'may'), '. ', '.\n')"
_LINES = "array_to_string(list_transform(list_filter(string_split({0}, chr(10)), lambda x, i: i < len(string_split({0}, chr(10))) OR x <> ''), lambda x: regexp_replace(x, '\\r$', '')), chr(10))"


@_query("diff_replay", f"SELECT prompt_id, {_LINES.format('text')} AS old_text, {_LINES.format('other')} AS new_text FROM (SELECT prompt_id, text, replace(replace(text, 'must', 'may'), '. ', '.' || chr(10)) AS other FROM ({CORPUS}))")
def diff_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prompt and an edited one from the lines of their difference: those that aren't inserted, and those that aren't deleted."""
    df = prompt_corpus(spark, sf_dir).withColumn("d", compare.line_diff("text", F.expr(_EDITED)))
    side = lambda gone, name: F.expr(f"array_join(transform(filter(d.ops, x -> x.op <> '{gone}'), x -> x.text), '\n')").alias(name)
    return df.select("prompt_id", side("ins", "old_text"), side("del", "new_text"))
