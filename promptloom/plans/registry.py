"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import CHECK, SPARK, Dialect, apply, ctes, query
from ..operators import compare, evaluate, firewall, lint, memory, optimize, parse, receipt, report, rewrite, score
from ..sources import library
from .corpus import TEMPLATES, corpus_sql, prompt_corpus, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DOCS_SQL = "SELECT doc_id AS prompt_id, text FROM documents"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as prompt_id", "text"))


def _steps(name: str, base, base_sql: str, make, columns: dict[str, str], rows: str | None = None) -> None:
    """Register one query of steps. ``columns``: output name to expression; with ``rows`` one row per element x of that array."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = apply(base(spark, sf_dir), make(SPARK))
        if rows:
            # not explode: the filter that Spark infers for it would work out the whole array a second time
            df = df.select("prompt_id", F.explode_outer(rows).alias("x")).where("x is not null")
        return df.selectExpr("prompt_id", *(f"{e} as {n}" for n, e in columns.items()))

    chosen = ", ".join(["prompt_id", *(f"{e} AS {n}" for n, e in columns.items())])
    source = f"(SELECT prompt_id, unnest({rows}) AS x FROM result)" if rows else "result"
    QUERIES[name] = run
    SQL[name] = query(base_sql, make(CHECK), f"SELECT {chosen} FROM {source}")


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(*names: str) -> dict[str, str]:
    return {n: f"round({n}, 6)" for n in names}


CORPUS = corpus_sql()
_base = lambda d: parse.basics(d)
_intent = lambda d: [*parse.basics(d), *parse.intent(d)]
_rules = lambda d: [*_intent(d), *parse.lines(d), *parse.constraints(d)]
_vague = lambda d: [*_rules(d), *lint.ambiguity(d)]
_parts = lambda d: [*_vague(d), *parse.sections(d, "tokens")]
_safe = lambda d: [*_parts(d), *lint.safety(d)]


def _scored(d: Dialect):
    return [*_safe(d), *score.objectives(d, score.Options()), *score.route(d)]


def _with_schema_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parse.with_schema(prompt_corpus(spark, sf_dir).withColumn("lc", F.expr(X.lower(SPARK, "text"))))
    return df.drop("lc")


def _guarded(d: Dialect):
    none = "cast(null as double)"
    return [("lc", X.lower(d, "text")), *parse.lines(d), *parse.sections(d), *firewall.secrets(d), *((f"ctx_{c}", none) for c in firewall.CONTEXT), *firewall.firewall(d)]


_issue = {"severity": "x.severity", "code": "x.code", "snippet": "x.snippet", "line": "x.line"}
_steps("token_count", _docs, DOCS_SQL, _base, {"tokens": "tokens"})
_steps("text_stats", _docs, DOCS_SQL, _base, {"chars": "chars", "words": "words"})
_steps("intent", prompt_corpus, CORPUS, _intent, {"task_type": "task_type", "output_type": "output_type", "audience": "audience", **rounded("confidence")})
_steps("constraints_extract", prompt_corpus, CORPUS, _rules, {"polarity": "x.polarity", "rule": "x.text", "category": "x.category", "line": "x.line"}, "constraints")
_steps("ambiguity_issues", prompt_corpus, CORPUS, _vague, _issue, "ambiguities")
_steps("clarity", prompt_corpus, CORPUS, _vague, rounded("clarity"))
_steps("sections", prompt_corpus, CORPUS, lambda d: [*parse.lines(d), *parse.sections(d)], {n: f"x.{n}" for n in ("kind", "title", "content", "tokens", "start_line", "end_line")}, "sections")
_steps("safety_issues", prompt_corpus, CORPUS, _safe, _issue, "safety")
_steps("safety_margin", prompt_corpus, CORPUS, _safe, rounded("safety_margin"))
_steps("score_objectives", _with_schema_score, CORPUS, _scored, {**rounded(*score.NAMES, "composite", "est_cost_usd", "est_latency_ms", "coverage"), "tokens": "tokens"})
_steps("route_hint", _with_schema_score, CORPUS, _scored, {**rounded("complexity"), "tier": "tier", "needs_reasoning": "needs_reasoning"})
_steps("firewall_findings", prompt_corpus, CORPUS, _guarded, {"code": "x.code", "severity": "x.severity", "snippet": "x.snippet"}, "findings")
_steps("firewall_decision", prompt_corpus, CORPUS, _guarded, {**rounded("risk", *firewall.CONTEXT[:3], "instruction_conflict"), "decision": "decision", "create_incident": "create_incident", "dominant": "dominant"})
_steps("scrub_secrets", prompt_corpus, CORPUS, firewall.scrub, {"scrubbed": "scrubbed", "redactions": "redactions"})
_steps("numbers_and_entities", _docs, DOCS_SQL, lambda d: [("n", compare.numbers(d, "text")), ("e", compare.entities(d, "text"))], {"n_numbers": "cast(cardinality(n) as bigint)", "n_entities": "cast(cardinality(e) as bigint)"})
SQL["numbers_and_entities"] = SQL["numbers_and_entities"].replace("cardinality(", "len(")


def _drifted(d: Dialect):
    shorter = "replace(replace(replace(text, 'must', 'may'), '3', ''), 'Never', 'Rarely')"
    low = [("_lc", X.lower(d, "text"))] if d.name == "spark" else []
    return [("transformed", shorter), *low, *parse.lines(d), *parse.constraints(d, "_lc" if low else X.lower(d, "text")), *compare.drift(d)]


_steps("drift_report", prompt_corpus, CORPUS, _drifted, {**rounded("lexical_similarity", "number_retention", "entity_retention", "constraint_retention", "drift"), "lost_numbers": "array_join(lost_numbers, ' ')", "lost_entities": "array_join(lost_entities, ' ')", "within_tolerance": "within_tolerance"})
SQL["drift_report"] = SQL["drift_report"].replace("array_join(lost", "array_to_string(lost")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id as prompt_id", "role", "text").transform(spread)


@_query("firewall_by_role", query("SELECT conv_id AS prompt_id, role, text FROM conversations", _guarded(CHECK), "SELECT role, decision, count(*) AS n, round(avg(risk), 6) AS mean_risk FROM result GROUP BY role, decision"))
def firewall_by_role(spark, sf_dir):
    return apply(_turns(spark, sf_dir), _guarded(SPARK)).groupBy("role", "decision").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 6).alias("mean_risk"))


@_query("template_verdicts", query(CORPUS, _guarded(CHECK), "SELECT template_id, decision, count(*) AS n FROM result GROUP BY template_id, decision"))
def template_verdicts(spark, sf_dir):
    return apply(prompt_corpus(spark, sf_dir), _guarded(SPARK)).groupBy("template_id", "decision").agg(F.count("*").alias("n"))


@_query("schema_info", f"SELECT prompt_id, schema_score FROM ({CORPUS})")
def schema_info(spark, sf_dir):
    return _with_schema_score(spark, sf_dir).select("prompt_id", "schema_score")


@_query("task_summary", query(CORPUS, _intent(CHECK), "SELECT task_type, count(*) AS prompts, round(avg(tokens), 6) AS mean_tokens, round(sum(tokens) / 1000.0 * 0.003, 6) AS est_cost_usd FROM result GROUP BY task_type"))
def task_summary(spark, sf_dir):
    df = apply(prompt_corpus(spark, sf_dir), _intent(SPARK))
    return df.groupBy("task_type").agg(F.count("*").alias("prompts"), F.round(F.avg("tokens"), 6).alias("mean_tokens"), F.round(F.sum("tokens").cast("double") / 1000 * 0.003, 6).alias("est_cost_usd"))


flagship = task_summary


@_query("analyze", query(CORPUS, _scored(CHECK), f"""SELECT prompt_id, tokens, words, task_type, n_constraints, n_ambiguities, CAST(len(sections) AS BIGINT) AS n_sections, len(safety) AS n_safety,
  round(composite, 6) AS composite, tier, CASE tier {' '.join(f"WHEN '{t}' THEN '{', '.join(m)}'" for t, _, m in L.TIERS)} END AS route_examples FROM result"""))
def analyze(spark, sf_dir):
    df = score.analyze(prompt_corpus(spark, sf_dir))
    sizes = (F.size("sections").cast("long").alias("n_sections"), F.size("safety").cast("long").alias("n_safety"))
    return df.select("prompt_id", "tokens", "words", "task_type", "n_constraints", "n_ambiguities", *sizes, F.round("composite", 6).alias("composite"), "tier", F.array_join("route_examples", ", ").alias("route_examples"))


@_query("compress")
def compress(spark, sf_dir):
    return rewrite.compress(prompt_corpus(spark, sf_dir)).select("prompt_id", "compressed", "before_tokens", "after_tokens", "removed", "reduction", "passes")


@_query("compile_prompt", query(CORPUS, _parts(CHECK), f"SELECT prompt_id, {rewrite.compiled(d=CHECK, has_schema='schema_present')} AS compiled FROM result"))
def compile_prompt(spark, sf_dir):
    return score.analyze(prompt_corpus(spark, sf_dir)).select("prompt_id", F.expr(rewrite.compiled()).alias("compiled"))


@_query("optimize")
def optimize_query(spark, sf_dir):
    done = optimize.optimize(prompt_corpus(spark, sf_dir), score.Options(witness_key="demo", issued_at="2024-01-01T00:00:00Z"))
    return done.select("prompt_id", "label", "token_reduction", "objectives_improved", "accepted", "drift", "within_tolerance", "bundle_hash", "witness", F.size("diff.ops").alias("n_ops"))


@_query("optimize_candidates")
def optimize_candidates(spark, sf_dir):
    return optimize.listed(optimize.judged(optimize.gathered(prompt_corpus(spark, sf_dir)))).select("prompt_id", "idx", "label", "tokens", "composite", "on_frontier", "accepted")


@_query("corpus_validation")
def corpus_validation(spark, sf_dir):
    """Shares and means over the corpus, as numbers: acceptance, cost and quality wins, the compression lever, regressions, drift, schemas, flags."""
    return report.report(report.state(prompt_corpus(spark, sf_dir)))


@_query("line_diff")
def line_diff(spark, sf_dir):
    df = prompt_corpus(spark, sf_dir).withColumn("other", F.expr("replace(replace(text, 'must', 'may'), '. ', '.\\n')"))
    return df.withColumn("d", compare.line_diff("text", "other")).selectExpr("prompt_id", "cast(size(d.ops) as bigint) as n_ops", "cast(size(filter(d.ops, x -> x.op = 'eq')) as bigint) as n_equal")


# ---- candidates with made-up scores, so that frontier and selection can be checked in SQL

_GRID = {n: f"cast((doc_id * {7 + 2 * i} + idx * {13 + 4 * i} + {i}) % {11 + i} as double) / 16" for i, n in enumerate(score.NAMES)}
_GRID_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in _GRID.items())


def _grid(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").crossJoin(spark.range(4).selectExpr("cast(id as int) as idx"))
    df = df.selectExpr("doc_id as prompt_id", "idx", "cast((doc_id * 3 + idx * 17) % 97 as bigint) as tokens", *(f"{e} as {n}" for n, e in _GRID.items()))
    return df.withColumn("est_cost_usd", F.lit(0.0)).withColumn("est_latency_ms", F.lit(0.0)).withColumn("composite", F.expr(score.composite()))


_GRID_SQL = f"g0 AS (SELECT doc_id AS prompt_id, CAST(idx AS INTEGER) AS idx, CAST((doc_id * 3 + idx * 17) % 97 AS BIGINT) AS tokens, {_GRID_COLUMNS} FROM documents, range(4) r(idx)), g AS (SELECT *, {score.composite()} AS composite FROM g0)"
_FLOOR_SQL = f"""{_GRID_SQL}, f0 AS (SELECT g.prompt_id, g.idx, g.tokens, {', '.join(f'greatest(g.{n}, b.{n}) AS {n}' if n in optimize.FLOORED else f'g.{n}' for n in score.NAMES)} FROM g JOIN g b ON b.prompt_id = g.prompt_id AND b.idx = 0),
f AS (SELECT *, {score.composite()} AS composite FROM f0)"""


@_query("pareto_frontier", f"WITH {_GRID_SQL} SELECT prompt_id, idx, NOT EXISTS (SELECT 1 FROM g o WHERE o.prompt_id = g.prompt_id AND {score.dominates('o', 'g')}) AS on_frontier, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY composite DESC, idx) AS INTEGER) AS rank FROM g")
def pareto_frontier(spark, sf_dir):
    return score.rank(score.pareto(_grid(spark, sf_dir))).select("prompt_id", "idx", "on_frontier", "rank")


@_query("optimize_winner", f"""WITH {_FLOOR_SQL}, a AS (SELECT c.*, c.idx > 0 AND {score.accepted()} AS accepted, CAST({score.improved_count()} AS BIGINT) AS objectives_improved FROM f c JOIN f b ON b.prompt_id = c.prompt_id AND b.idx = 0),
m AS (SELECT *, max(composite) FILTER (accepted) OVER (PARTITION BY prompt_id) AS best FROM a),
p AS (SELECT *, accepted AND composite >= best - {optimize.BAND} AS chosen FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY coalesce(chosen, false) DESC, CASE WHEN chosen THEN tokens END NULLS LAST, CASE WHEN chosen THEN composite END DESC NULLS LAST, idx) AS k FROM p)
SELECT prompt_id, idx, accepted, objectives_improved, round(composite, 6) AS composite, tokens FROM r WHERE k = 1""")  # fmt: skip
def optimize_winner(spark, sf_dir):
    won = optimize.select_winner(optimize.floored(_grid(spark, sf_dir)))
    return won.select("prompt_id", "idx", "accepted", "objectives_improved", F.round("composite", 6).alias("composite"), "tokens")


# ---- receipts

_KEY, _AT = "demo-key", "2024-01-01T00:00:00Z"
_CANON = """'v1|src:' || sha256(text) || '|art:' || sha256(upper(lang)) || '|base:' || printf('%.6f', (doc_id % 64) / 64.0) || '|opt:' || printf('%.6f', (doc_id % 32) / 32.0)
 || '|red:' || printf('%.6f', (doc_id % 16) / 16.0) || '|imp:' || (doc_id % 8) || '|acc:' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '|ts:""" + _AT + "'"
_PADS = ["".join(f"{b ^ p:02x}" for b in _KEY.encode().ljust(64, b"\0")) for p in (0x36, 0x5C)]


def _receipts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id as prompt_id", "text as original", "upper(lang) as optimized", "(doc_id % 64) / 64D as base_composite", "(doc_id % 32) / 32D as opt_composite",
        "(doc_id % 16) / 16D as token_reduction", "doc_id % 8 as objectives_improved", "doc_id % 2 = 0 as accepted")
    return receipt.build(df, _KEY, _AT)


@_query("receipt_hash", f"SELECT doc_id AS prompt_id, sha256({_CANON}) AS bundle_hash, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode({_CANON})))) AS witness FROM documents")
def receipt_hash(spark, sf_dir):
    return _receipts(spark, sf_dir).select("prompt_id", "bundle_hash", "witness")


@_query("receipt_verify", "SELECT doc_id AS prompt_id, doc_id % 3 <> 0 AS verified FROM documents")
def receipt_verify(spark, sf_dir):
    """Every third receipt is tampered with and must fail."""
    df = _receipts(spark, sf_dir).withColumn("token_reduction", F.expr("if(prompt_id % 3 = 0, token_reduction + 1, token_reduction)"))
    return receipt.verify(df, _KEY, _AT).select("prompt_id", "verified")


# ---- memory and vectors

_GRAMS = """WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS g FROM t),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(g, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM g),
s AS (SELECT doc_id, h % 256 AS dim, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS v FROM h GROUP BY doc_id, h % 256),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY doc_id)
SELECT s.doc_id, CAST(dim AS INTEGER) AS dim, round(v / n, 6) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0"""


@_query("hash_embed", _GRAMS)
def hash_embed(spark, sf_dir):
    df = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", memory.hash_embed("text").alias("v"))
    return df.select("doc_id", F.posexplode("v").alias("dim", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_WRITES = "cast((event_id * 7919) % 1500 as string) AS id, event_id AS seq, event_type AS decision, value AS composite"


@_query("memory_upsert_cap", f"WITH w AS (SELECT {_WRITES} FROM events), m AS (SELECT id, min(seq) AS place, arg_max(decision, seq) AS decision, arg_max(composite, seq) AS composite FROM w GROUP BY id) SELECT id, place, decision, composite FROM m ORDER BY place DESC LIMIT {memory.MAX_ENTRIES}")
def memory_upsert_cap(spark, sf_dir):
    writes = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*["cast((event_id * 7919) % 1500 as string) as id", "event_id as seq", "event_type as decision", "value as composite"])
    return memory.upsert(writes).select("id", "place", "decision", "composite")


_UNIT = "aggregate(embedding, 0D, (s, x) -> s + cast(x as double) * x)"


def _vectors(spark, sf_dir):
    return spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).selectExpr("vec_id", "label", f"get(transform(array(sqrt({_UNIT})), n -> transform(embedding, x -> cast(x as double) / n)), 0) as vector")


_VECTORS_SQL = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings)"
_MEMORY_SQL = f"{_VECTORS_SQL}, m AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT {memory.MAX_ENTRIES}), s AS (SELECT v.vec_id AS prompt_id, m.vec_id AS place, m.label, list_cosine_similarity(v.vector, m.vector) AS sim FROM v, m), r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY sim DESC, place) AS rank FROM s)"


def _recalled(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    kept = v.orderBy(F.desc("vec_id")).limit(memory.MAX_ENTRIES)
    entries = kept.selectExpr("vec_id as place", "vector", "if(label % 2 = 0, 'allow', 'block') as decision", "label % 3 as n_findings", "label % 2 = 0 as accepted")
    return memory.recall(v.selectExpr("vec_id as prompt_id", "vector"), entries)


@_query("memory_recall", f"WITH {_MEMORY_SQL} SELECT prompt_id, place, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {memory.NEIGHBOURS}")
def memory_recall(spark, sf_dir):
    return _recalled(spark, sf_dir).select("prompt_id", "place", F.round("similarity", 6).alias("similarity"), "rank")


@_query("prior_stats", f"""WITH {_MEMORY_SQL} SELECT prompt_id, round(greatest(0, least(1, max(CASE WHEN label % 2 <> 0 OR label % 3 > 0 THEN sim ELSE 0 END))), 6) AS prior_failure_similarity,
  round(greatest(0, least(1, max(CASE WHEN label % 2 = 0 THEN sim ELSE 0 END))), 6) AS prior_win_similarity FROM r WHERE rank <= {memory.NEIGHBOURS} GROUP BY prompt_id""")
def prior_stats(spark, sf_dir):
    return memory.priors(_recalled(spark, sf_dir)).select("prompt_id", F.round("prior_failure_similarity", 6).alias("prior_failure_similarity"), F.round("prior_win_similarity", 6).alias("prior_win_similarity"))


@_query("embedding_topk", f"""WITH {_VECTORS_SQL}, e AS (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS i FROM v), a AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), c AS (SELECT label AS id, list(x ORDER BY i) AS vector FROM a GROUP BY label),
s AS (SELECT v.vec_id AS query_id, c.id, list_cosine_similarity(v.vector, c.vector) AS sim FROM v, c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT query_id, id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def embedding_topk(spark, sf_dir):
    """Every vector's nearest label centroids."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    mean = raw.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = mean.groupBy("label").agg(F.expr("transform(array_sort(collect_list(struct(i, x))), y -> y.x) as c"))
    centres = centres.selectExpr("label as id", "transform(c, x -> x / sqrt(aggregate(c, 0D, (s, y) -> s + y * y))) as vector")
    near = memory.top_similar(_vectors(spark, sf_dir).selectExpr("vec_id as query_id", "vector"), centres, 3)
    return near.withColumn("similarity", F.round("similarity", 6))


_EXEMPLARS = ", ".join(f"({i}, '{t}', '{n}', '{x}')" for i, (t, n, x) in enumerate(L.ROUTE_EXEMPLARS))
_ROUTE_SQL = f"""WITH {ctes(CORPUS, _scored(CHECK))}, ex AS (SELECT * FROM (VALUES {_EXEMPLARS}) AS x(i, tier, name, text)),
tx AS (SELECT 'p' AS kind, prompt_id AS id, text FROM result WHERE text IS NOT NULL UNION ALL SELECT 'e', i, text FROM ex),
wd AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1) AS w FROM tx),
gr AS (SELECT kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS g FROM wd),
di AS (SELECT g, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(g, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT g FROM gr)),
ve AS (SELECT kind, id, h % 256 AS dim, sum(CASE WHEN h >= 2147483648 THEN -1 ELSE 1 END) AS v FROM gr JOIN di USING (g) GROUP BY ALL),
no AS (SELECT kind, id, sqrt(sum(v * v)) AS n FROM ve GROUP BY ALL),
dt AS (SELECT p.id AS prompt_id, e.id AS i, sum(p.v * e.v) AS d FROM ve p JOIN ve e ON p.kind = 'p' AND e.kind = 'e' AND p.dim = e.dim GROUP BY ALL),
si AS (SELECT t.id AS prompt_id, ex.i, ex.tier, ex.name, coalesce(d / nullif(np.n * ne.n, 0), 0) AS s FROM tx t CROSS JOIN ex LEFT JOIN dt ON dt.prompt_id = t.id AND dt.i = ex.i
  LEFT JOIN no np ON np.kind = 'p' AND np.id = t.id LEFT JOIN no ne ON ne.kind = 'e' AND ne.id = ex.i WHERE t.kind = 'p'),
be AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY round(s, 12) DESC, name, tier) AS r FROM si)
SELECT result.prompt_id, CASE WHEN s >= {memory.ROUTE_LEAST} THEN be.tier ELSE result.tier END AS tier, name AS exemplar, round(s, 6) AS similarity, coalesce(s >= {memory.ROUTE_LEAST}, false) AS overridden
FROM result LEFT JOIN be ON be.prompt_id = result.prompt_id AND r = 1"""


@_query("route_exemplar", _ROUTE_SQL)
def route_exemplar(spark, sf_dir):
    df = apply(_with_schema_score(spark, sf_dir), _scored(SPARK)).select("prompt_id", "tier", memory.hash_embed("text").alias("vector"))
    return memory.refine_route(df, memory.exemplars(spark)).withColumn("similarity", F.round("similarity", 6))


@_query("semantic_drift", f"WITH {_VECTORS_SQL}, p AS (SELECT a.vec_id, greatest(0, least(1, list_cosine_similarity(a.vector, b.vector))) AS s FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(coalesce(s, 1), 6) AS similarity, round(coalesce(1 - s, 0), 6) AS drift, s IS NOT NULL AS available FROM p".replace("greatest(0, least(1, list_cosine_similarity(a.vector, b.vector)))", "CASE WHEN b.vector IS NOT NULL THEN greatest(0, least(1, list_cosine_similarity(a.vector, b.vector))) END"))
def semantic_drift(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    nxt = v.selectExpr("vec_id - 1 as vec_id", "vector as other")
    df = v.join(nxt, "vec_id", "left").withColumn("d", compare.semantic_drift("vector", "other"))
    return df.selectExpr("vec_id", "round(d.similarity, 6) as similarity", "round(d.drift, 6) as drift", "d.available as available")


# ---- evaluation

MODELS = (("alpha", 0.5, 1.5), ("beta", 0.25, 0.75), ("gamma", None, None))
CASES = (("c0", "first input"), ("c1", "second {input}"), ("c2", "third"))
CHECKS = (
    ("c0", "json_valid", None, None), ("c0", "has_field", "answer", None), ("c0", "not_contains", "sorry", None),
    ("c1", "contains", "ANSWER", None), ("c1", "regex", "answer.*[0-9]", None), ("c1", "max_tokens", None, 40),
    ("c2", "refuses", None, None), ("c2", "regex", "(unclosed", None),
)


def _cell(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_cell, r)) + ")" for r in rows)


_MODELS = f"SELECT model, cast(prompt_usd AS double) AS prompt_usd, cast(completion_usd AS double) AS completion_usd FROM (VALUES {_values(MODELS)}) AS m(model, prompt_usd, completion_usd)"
_CASES = f"SELECT case_id, input FROM (VALUES {_values(CASES)}) AS c(case_id, input)"
_CHECKS = f"SELECT case_id, kind, arg, cast(n AS bigint) AS n FROM (VALUES {_values(CHECKS)}) AS k(case_id, kind, arg, n)"
#: Outputs by integer keys: an object, an object in prose, a refusal, or (every seventh) none.
_PICK = "(doc_id + 2 * idx + 3 * m + 5 * c)"
_CONTENT = f"""CASE {_PICK} % 4 WHEN 0 THEN '{{"answer": 1, "n": ' || {_PICK} || '}}' WHEN 1 THEN 'The answer is {{"x": ' || {_PICK} || '}} ok' WHEN 2 THEN 'Sorry, I cannot do that' ELSE '{{"answer": NaN}} answer 7' END"""
_OUTPUTS = """SELECT doc_id AS prompt_id, idx, {models} AS model, {cases} AS case_id, {content} AS content, cast(10 + doc_id % 90 AS bigint) AS prompt_tokens, cast(5 + idx * 3 AS bigint) AS completion_tokens,
  cast(100 * (1 + (doc_id + m) % 50) AS double) AS latency_ms FROM {grid} WHERE {pick} % 7 <> 3"""


def _suite(spark, sf_dir):
    ids = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))
    grid = ids.crossJoin(spark.range(2).selectExpr("cast(id as int) as idx")).crossJoin(spark.range(3).selectExpr("cast(id as int) as m")).crossJoin(spark.range(3).selectExpr("cast(id as int) as c"))
    text = _OUTPUTS.format(models="get(array('alpha', 'beta', 'gamma'), m)", cases="get(array('c0', 'c1', 'c2'), c)", content=_CONTENT, grid="_eval_grid", pick=_PICK)
    grid.createOrReplaceTempView("_eval_grid")
    outputs = spark.sql(text)
    cands = ids.crossJoin(spark.range(2).selectExpr("cast(id as int) as idx")).selectExpr("doc_id as prompt_id", "idx")
    cells = evaluate.cells(cands, spark.sql(_MODELS), spark.sql(_CASES), outputs)
    good = evaluate.usable_patterns(sorted({a for _, k, a, _ in CHECKS if k == "regex"}))
    return cands, evaluate.grade(cells, spark.sql(_CHECKS), good)


_EVAL_SQL = f"""WITH mo AS ({_MODELS}), ca AS ({_CASES}), ck AS ({_CHECKS}), gr AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, m, c FROM documents, range(2) a(idx), range(3) b(m), range(3) d(c)),
ou AS ({_OUTPUTS.format(models="(['alpha', 'beta', 'gamma'])[m + 1]", cases="(['c0', 'c1', 'c2'])[c + 1]", content=_CONTENT, grid="gr", pick=_PICK)}),
cd AS (SELECT doc_id AS prompt_id, CAST(idx AS INTEGER) AS idx FROM documents, range(2) a(idx)),
ce AS (SELECT cd.prompt_id, cd.idx, mo.model, ca.case_id, content, coalesce(latency_ms, 0) AS latency_ms, coalesce(prompt_tokens / 1000.0 * coalesce(prompt_usd, 0) + completion_tokens / 1000.0 * coalesce(completion_usd, 0), 0) AS cost_usd
  FROM cd, mo, ca LEFT JOIN ou ON ou.prompt_id = cd.prompt_id AND ou.idx = cd.idx AND ou.model = mo.model AND ou.case_id = ca.case_id),
ev AS (SELECT ce.*, ck.kind, CASE WHEN content IS NULL THEN false WHEN kind = 'json_valid' THEN starts_with(content, '{{"answer": 1') OR starts_with(content, 'The') WHEN kind = 'has_field' THEN starts_with(content, '{{"answer": 1')
  WHEN kind = 'contains' THEN contains(lower(content), lower(arg)) WHEN kind = 'not_contains' THEN NOT contains(lower(content), lower(arg)) WHEN kind = 'regex' THEN arg <> '(unclosed' AND regexp_matches(content, '(?i)answer.*[0-9]')
  WHEN kind = 'max_tokens' THEN greatest(1, floor(length(content) / 4 + 0.5)) <= n WHEN kind = 'refuses' THEN contains(lower(content), 'i cannot') END AS ok FROM ce JOIN ck USING (case_id)),
gd AS (SELECT prompt_id, idx, model, case_id, count(*) FILTER (ok) AS checks_passed, count(*) AS checks_total, count(*) FILTER (ok AND kind IN ('json_valid', 'has_field')) AS schema_passed,
  count(*) FILTER (kind IN ('json_valid', 'has_field')) AS schema_total, first(latency_ms) AS latency_ms, first(cost_usd) AS cost_usd, bool_and(ok) AS pass FROM ev GROUP BY ALL),
pm AS (SELECT prompt_id, idx, model, count(*) FILTER (pass) / count(*) AS accuracy FROM gd GROUP BY ALL),
st AS (SELECT prompt_id, idx, greatest(0, least(1, 1 - 2 * stddev_pop(accuracy))) AS stability FROM pm GROUP BY ALL),
ag AS (SELECT prompt_id, idx, count(*) FILTER (pass) / count(*) AS accuracy, coalesce(sum(schema_passed) / nullif(sum(schema_total), 0), 0.6) AS schema_validity, avg(latency_ms) AS mean_latency_ms, sum(cost_usd) AS total_cost_usd FROM gd GROUP BY ALL),
sc AS (SELECT ag.*, stability AS cross_model_stability, CAST(0.5 AS DOUBLE) AS token_efficiency, 1 / (1 + mean_latency_ms / 4000.0) AS latency_efficiency, CAST(1 AS DOUBLE) AS safety_margin, CAST(0.7 AS DOUBLE) AS explainability FROM ag JOIN st USING (prompt_id, idx)),
rk AS (SELECT *, {score.composite()} AS composite FROM sc)"""


@_query("eval_cells", f"{_EVAL_SQL} SELECT prompt_id, idx, model, case_id, checks_passed, checks_total, schema_passed, schema_total, pass, round(cost_usd, 6) AS cost_usd FROM gd")
def eval_cells(spark, sf_dir):
    graded = _suite(spark, sf_dir)[1]
    return graded.select("prompt_id", "idx", "model", "case_id", "checks_passed", "checks_total", "schema_passed", "schema_total", "pass", F.round("cost_usd", 6).alias("cost_usd"))


@_query("eval_per_model", f"{_EVAL_SQL} SELECT prompt_id, idx, model, round(accuracy, 6) AS accuracy FROM pm")
def eval_per_model(spark, sf_dir):
    return evaluate.per_model(_suite(spark, sf_dir)[1]).withColumn("accuracy", F.round("accuracy", 6))


@_query("eval_rank", f"{_EVAL_SQL} SELECT prompt_id, idx, round(accuracy, 6) AS accuracy, round(schema_validity, 6) AS schema_validity, round(cross_model_stability, 6) AS cross_model_stability, round(mean_latency_ms, 4) AS mean_latency_ms, round(total_cost_usd, 6) AS total_cost_usd, round(composite, 6) AS composite, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY composite DESC, idx) AS INTEGER) AS rank FROM rk")
def eval_rank(spark, sf_dir):
    cands, graded = _suite(spark, sf_dir)
    static = cands.selectExpr("*", "0.6D as schema_validity", "0.5D as token_efficiency", "1D as safety_margin", "0.7D as explainability")
    out = evaluate.ranked(evaluate.aggregate(graded, static))
    return out.select("prompt_id", "idx", *(F.round(c, 4 if c == "mean_latency_ms" else 6).alias(c) for c in ("accuracy", "schema_validity", "cross_model_stability", "mean_latency_ms", "total_cost_usd", "composite")), "rank")


@_query("eval_totals", f"{_EVAL_SQL} SELECT count(*) AS calls, round(sum(cost_usd), 4) AS cost_usd, count(*) FILTER (pass) AS passed FROM gd")
def eval_totals(spark, sf_dir):
    return evaluate.totals(_suite(spark, sf_dir)[1]).withColumn("cost_usd", F.round("cost_usd", 4))


_LABELS = "case idx when 0 then 'original' else 'compiled' end"


@_query("eval_winner", f"{_EVAL_SQL}, wi AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY composite DESC, idx) AS r FROM rk) SELECT gd.prompt_id, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd, max({_LABELS.replace('idx', 'wi.idx')}) AS winner FROM gd JOIN wi ON wi.prompt_id = gd.prompt_id AND wi.r = 1 GROUP BY gd.prompt_id")
def eval_winner(spark, sf_dir):
    cands, graded = _suite(spark, sf_dir)
    static = cands.selectExpr("*", f"{_LABELS} as label", "0.6D as schema_validity", "0.5D as token_efficiency", "1D as safety_margin", "0.7D as explainability")
    won = evaluate.winners(graded, evaluate.ranked(evaluate.aggregate(graded, static)))
    return won.withColumn("cost_usd", F.round("cost_usd", 6))


@_query("build_prompt", f"""SELECT prompt_id, CASE WHEN h <> '' THEN substr(text, 1, instr(text, h) - 1) || 'INPUT' || substr(text, instr(text, h) + length(h)) ELSE text || chr(10) || chr(10) || 'Input:' || chr(10) || 'INPUT' END AS prompt
FROM (SELECT *, regexp_extract(text, '([{{][A-Za-z_]+[}}])', 1) AS h FROM ({CORPUS}))""")
def build_prompt(spark, sf_dir):
    return prompt_corpus(spark, sf_dir).withColumn("input", F.lit("INPUT")).selectExpr("prompt_id", f"{evaluate.build_prompt()} as prompt")


# ---- library

@_query("sse_decode", "SELECT conv_id, turn, text FROM conversations")
def sse_decode(spark, sf_dir):
    """Turns as event streams, with blank, foreign, malformed and closing lines, decoded again."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    payload = F.concat(F.lit("event: x\n\ndata: "), body, F.lit("\ndata: {oops\n: note\ndata: [DONE]\n"))
    return rows.withColumn("payload", payload).select("conv_id", "turn", library.sse_text().alias("text"))


@_query("front_matter", "SELECT page_id, 'Page: ' || page_id AS title, url, html AS body FROM pages")
def front_matter(spark, sf_dir):
    """Pages as files with front matter, taken apart again; a value keeps its colons."""
    raw = F.concat(F.lit("---\ntitle: Page: "), F.col("page_id").cast("string"), F.lit("\nurl: "), F.col("url"), F.lit("\n---\n"), F.col("html"))
    df = library.front_matter(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("raw", raw))
    return df.select("page_id", F.col("meta")["title"].alias("title"), F.col("meta")["url"].alias("url"), "body")


@_query("model_pricing", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS name, CAST(4096 AS BIGINT) AS context_length, round(o_totalprice * 1000, 2) AS prompt_usd, 0.0::DOUBLE AS completion_usd FROM orders")
def model_pricing(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("cast(o_orderkey as string) as id", "o_orderpriority as name", "cast(null as string) as description", "cast(null as bigint) as context_length", "named_struct('prompt', cast(o_totalprice as string), 'completion', 'n/a') as pricing")
    return library.model_catalogue(df).select("id", "name", "context_length", F.round("prompt_usd", 2).alias("prompt_usd"), "completion_usd")


@_query("export_prompts", "SELECT page_id, '# ' || url || chr(10) || chr(10) || html AS markdown, 'url = \"' || url || '\"' AS toml, 'Domain: web' || chr(10) || chr(10) || 'Overview: ' || url || chr(10) || chr(10) || html AS prompt FROM pages")
def export_prompts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("domain", F.lit("web")).withColumn("none", F.lit(None).cast("string"))
    return df.select("page_id", library.export_markdown("url", "html").alias("markdown"), library.export_toml("url").alias("toml"), library.assemble("domain", "none", "none", "url", "html").alias("prompt"))


@_query("rescore", f"WITH {_GRID_SQL} SELECT prompt_id, idx, round(composite, 6) AS composite FROM g")
def rescore(spark, sf_dir):
    """Composites recomputed from the objectives, whatever was there."""
    return score.rescore(_grid(spark, sf_dir).withColumn("composite", F.lit(-1.0))).select("prompt_id", "idx", F.round("composite", 6).alias("composite"))


@_query("version", f"SELECT '{__version__}' AS version")
def version(spark, sf_dir):
    return spark.range(1).select(F.lit(__version__).alias("version"))


@_query("title_fallback", "SELECT doc_id, CASE WHEN source IS NULL THEN NULL ELSE 'S' || substr(source, 2) || ' ' || upper(substr(lang, 1, 1)) || substr(lang, 2) || ' NoTe ' || doc_id END AS title FROM documents")
def title_fallback(spark, sf_dir):
    """Titles from file names: the team's prefix goes, only first letters change."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    team = F.element_at(F.array(*map(F.lit, ("redteam-", "blueteam-", ""))), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", library.title(F.concat(team, "source", F.lit("-"), "lang", F.lit("-noTe-"), F.col("doc_id").cast("string"))).alias("title"))


@_query("delete_saved", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS content FROM customer WHERE c_custkey <> 7")
def delete_saved(spark, sf_dir):
    """Saved prompts without the one whose id is 7."""
    saved = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("cast(c_custkey as string) as id", "c_name as content")
    return library.without(saved, "7")


@_query("diff_markdown", "SELECT page_id, CASE WHEN html IS NOT NULL THEN '```diff' || chr(10) || array_to_string(list_transform(list_filter(string_split(html, chr(10)), lambda x, i: i < len(string_split(html, chr(10))) OR x <> ''), lambda x: '- ' || regexp_replace(x, '\\r$', '') || chr(10)), '') || '```' || chr(10) END AS markdown FROM pages")
def diff_markdown(spark, sf_dir):
    """The rendered difference between every page and nothing: all of its lines are deleted."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return pages.select("page_id", compare.line_diff("html", F.lit(""))["markdown"].alias("markdown"))


def _chat(model: str, prompt: str) -> dict:
    """Stands in for a model: deterministic, without a count of its own for the prompt."""
    return {"content": f"{model} read {len(prompt)}", "prompt_tokens": None, "completion_tokens": 3, "latency_ms": float(len(model))}


@_query("chat_outputs", f"""SELECT prompt_id, 0 AS idx, model, 'c' AS case_id, model || ' read ' || length(text) AS content, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(floor(n / 4 + 0.5) AS BIGINT)) END AS prompt_tokens,
  CAST(3 AS BIGINT) AS completion_tokens, CAST(length(model) AS DOUBLE) AS latency_ms FROM (SELECT *, length({X.trim(CHECK, 'text')}) AS n FROM ({CORPUS}) WHERE text IS NOT NULL), (VALUES ('alpha'), ('beta')) AS m(model)""")
def chat_outputs(spark, sf_dir):
    """A user's model function over the corpus; missing token counts are estimated."""
    models = F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("model")
    grid = prompt_corpus(spark, sf_dir).where("text is not null").select("prompt_id", F.lit(0).alias("idx"), models, F.lit("c").alias("case_id"), F.col("text").alias("prompt"))
    return evaluate.call_models(grid, _chat)


@_query("eval_frontier", f"""WITH {_GRID_SQL}, c AS (SELECT prompt_id, idx, NOT EXISTS (SELECT 1 FROM g o WHERE o.prompt_id = g.prompt_id AND {score.dominates('o', 'g')}) AS on_frontier FROM g)
SELECT prompt_id, idx, count(*) AS cells FROM c, ({_MODELS}) m, ({_CASES}) k WHERE on_frontier GROUP BY prompt_id, idx""")
def eval_frontier(spark, sf_dir):
    """Cells per candidate: only candidates on the frontier are evaluated."""
    none = spark.createDataFrame([], "prompt_id long, idx int, model string, case_id string, content string, prompt_tokens long, completion_tokens long, latency_ms double")
    cells = evaluate.cells(score.pareto(_grid(spark, sf_dir)).select("prompt_id", "idx", "on_frontier"), spark.sql(_MODELS), spark.sql(_CASES), none)
    return cells.groupBy("prompt_id", "idx").agg(F.count("*").alias("cells"))


@_query("bench_rank", f"{_EVAL_SQL}, b AS (SELECT prompt_id, idx, count(*) FILTER (pass) / count(*) AS accuracy, avg(latency_ms) AS mean_latency_ms FROM gd WHERE model = 'alpha' GROUP BY ALL) SELECT prompt_id, idx, round(accuracy, 6) AS accuracy, CAST(1 AS DOUBLE) AS cross_model_stability, round(1 / (1 + mean_latency_ms / 4000.0), 6) AS latency_efficiency FROM b")
def bench_rank(spark, sf_dir):
    """Measured with a single model, the stability is 1."""
    cands, graded = _suite(spark, sf_dir)
    static = cands.selectExpr("*", "0.6D as schema_validity", "0.5D as token_efficiency", "1D as safety_margin", "0.7D as explainability")
    out = evaluate.aggregate(graded.where("model = 'alpha'"), static)
    return out.select("prompt_id", "idx", F.round("accuracy", 6).alias("accuracy"), "cross_model_stability", F.round("latency_efficiency", 6).alias("latency_efficiency"))


_TEAM = f"case when template_id < {len(TEMPLATES) // 2} then 'redteam-case-' || template_id when template_id < {len(TEMPLATES) - 4} then 'blueteam-case-' || template_id else 'framework-' || template_id end"


@_query("team_verdicts", f"WITH {ctes(CORPUS, _guarded(CHECK))}, n AS (SELECT *, {_TEAM} AS name FROM result) SELECT split_part(name, 'team-', 1) AS team, 'Case ' || template_id AS title, count(*) AS n, count(*) FILTER ((decision <> 'allow') = starts_with(name, 'red')) AS as_wanted FROM n WHERE NOT starts_with(name, 'framework') GROUP BY ALL")
def team_verdicts(spark, sf_dir):
    """The corpus as templates of two teams: how many of each are judged as their team wants."""
    named = prompt_corpus(spark, sf_dir).selectExpr(f"{_TEAM} as name", "text as body")
    return library.verdicts(named).groupBy("team", "title").agg(F.count("*").alias("n"), F.count_if("as_wanted").alias("as_wanted"))


@_query("front_matter_parts", "SELECT page_id, 'Page' AS title, url, html AS body FROM pages")
def front_matter_parts(spark, sf_dir):
    """The other reading of front matter: a value ends at a second ': '."""
    raw = F.concat(F.lit("---\ntitle: Page: "), F.col("page_id").cast("string"), F.lit("\nurl: "), F.col("url"), F.lit("\n---\n"), F.col("html"))
    df = library.front_matter_by_parts(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("raw", raw))
    return df.select("page_id", F.col("meta")["title"].alias("title"), F.col("meta")["url"].alias("url"), "body")


def _guarded_by_memory(d: Dialect):
    return [(n, "prior" if n == "ctx_prior_failure_similarity" else e) for n, e in _guarded(d)]


_MEMORY_GUARD = f"""WITH {_MEMORY_SQL}, pr AS (SELECT prompt_id, greatest(0, least(1, max(CASE WHEN label % 2 <> 0 OR label % 3 > 0 THEN sim ELSE 0 END))) AS prior FROM r WHERE rank <= {memory.NEIGHBOURS} GROUP BY prompt_id),
{ctes("SELECT doc_id AS prompt_id, text, coalesce(prior, 0) AS prior FROM documents LEFT JOIN pr ON pr.prompt_id = doc_id", _guarded_by_memory(CHECK))}
SELECT prompt_id, round(prior_failure_similarity, 6) AS prior_failure_similarity, round(risk, 6) AS risk, decision FROM result"""


@_query("firewall_memory", _MEMORY_GUARD)
def firewall_memory(spark, sf_dir):
    """Decisions on every document, with what the memory knows of its neighbours; without a vector it has none."""
    prior = memory.priors(_recalled(spark, sf_dir)).withColumnRenamed("prior_failure_similarity", "prior")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as prompt_id", "text"))
    df = firewall.assess(docs.join(prior, "prompt_id", "left").fillna(0.0, ["prior"]), {"prior_failure_similarity": "prior"})
    return df.select("prompt_id", F.round("prior_failure_similarity", 6).alias("prior_failure_similarity"), F.round("risk", 6).alias("risk"), "decision")


@_query("weights", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({w} AS DOUBLE))" for n, w in L.OBJECTIVES) + ") AS w(objective, weight)")
def weights(spark, sf_dir):
    return spark.sql("SELECT explode(map(" + ", ".join(f"'{n}', {w}D" for n, w in score.weights().items()) + ")) AS (objective, weight)")
