"""Measured evaluation: the candidate x model x case matrix, grading, aggregates and ranking."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import SPARK
from ..sources.tablelog import COMPACT_AT, TableLog
from . import parse
from .memory import sized
from .score import composite

#: Milliseconds at which latency counts half. Fixed value.
LATENCY_BUDGET = 4000.0
#: Rows of a suite's models, cases or checks that are broadcast at most.
SUITE_ROWS = 10_000
SCHEMA_CHECKS = ("json_valid", "has_field")


def build_prompt(text: str = "text", input: str = "input") -> str:
    """The input in place of the first {name}, or after the text."""
    hole = f"regexp_extract({text}, '([{{][A-Za-z_]+[}}])', 1)"
    return f"case when {hole} <> '' then concat(substring({text}, 1, instr({text}, {hole}) - 1), {input}, substring({text}, instr({text}, {hole}) + length({hole}))) else concat({text}, '\\n\\nInput:\\n', {input}) end"


def est_tokens(text: str) -> str:
    """A quarter of the trimmed characters, at least 1 unless empty."""
    n = f"length({X.trim(SPARK, text)})"
    return f"case when {n} = 0 then cast(0 as bigint) else greatest(cast(1 as bigint), cast(floor({n} / 4 + 0.5D) as bigint)) end"


def json_fields(output: str) -> Column:
    """Keys of the first balanced object; null if there is none or it doesn't parse."""
    return F.expr(parse.keys(parse.first_block(output)))


def usable_patterns(patterns: list[str]) -> list[str]:
    """Those that the engine compiles; a check with another pattern fails, not the job."""
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    good = []
    for p in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(p)
            good.append(p)
        except Exception:  # noqa: BLE001  the engine's own error type
            continue
    return good


def cells(candidates: DataFrame, models: DataFrame, cases: DataFrame, outputs: DataFrame, frontier_only: bool = True) -> DataFrame:
    """One cell per candidate, model and case, with what the model gave; ``called`` is false where it gave nothing.

    ``models`` and ``cases`` are the suite's own small tables (at most SUITE_ROWS); candidates may be many. Of
    candidates with an ``on_frontier`` mark only those on the frontier are evaluated, unless ``frontier_only`` is off.
    """
    if frontier_only and "on_frontier" in candidates.columns:
        candidates = candidates.where("on_frontier")
    grid = candidates.crossJoin(sized(models, SUITE_ROWS)).crossJoin(sized(cases, SUITE_ROWS))
    out = grid.join(outputs, ["prompt_id", "idx", "model", "case_id"], "left").withColumn("called", F.col("content").isNotNull())
    cost = F.coalesce(F.col("prompt_tokens") / 1000.0 * F.coalesce("prompt_usd", F.lit(0.0)) + F.col("completion_tokens") / 1000.0 * F.coalesce("completion_usd", F.lit(0.0)), F.lit(0.0))
    return out.withColumn("cost_usd", cost).withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))


def call_models(grid: DataFrame, chat: Callable[[str, str], dict]) -> DataFrame:
    """What a user's ``chat(model, prompt)`` gives for every row of ``grid`` (prompt_id, idx, model, case_id, prompt): the outputs that ``cells`` joins.

    It returns content, prompt_tokens, completion_tokens and latency_ms. Missing token counts are estimated from
    the texts; a call that raises gives no row, so its cell counts as failed.
    """
    keys = ["prompt_id", "idx", "model", "case_id"]
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "prompt string", "content string", "prompt_tokens long", "completion_tokens long", "latency_ms double"])

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf[[*keys, "prompt"]].itertuples(index=False):
                try:
                    got = chat(row.model, row.prompt)
                except Exception:  # noqa: BLE001  whatever the user's function raises is a failed call
                    continue
                rows.append((*row, got.get("content"), got.get("prompt_tokens"), got.get("completion_tokens"), got.get("latency_ms")))
            out = pd.DataFrame(rows, columns=[*keys, "prompt", "content", "prompt_tokens", "completion_tokens", "latency_ms"])
            yield out.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64", "latency_ms": "Float64"})

    out = grid.mapInPandas(run, schema)
    for count, of in (("prompt_tokens", "prompt"), ("completion_tokens", "content")):
        out = out.withColumn(count, F.coalesce(count, F.expr(est_tokens(of))))
    return out.drop("prompt")


class CallLedger:
    """What models answered, by the hash of model and prompt: every distinct pair is asked once, in whatever cells, runs and retries it comes.

    Answers are a part of a table per call of ``outputs``, committed when all of it is there. Calls that fail are not
    kept: they are tried again the next time.
    """

    SCHEMA = "key string, model string, content string, prompt_tokens long, completion_tokens long, latency_ms double"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = TableLog(spark, path, self.SCHEMA)

    def answers(self) -> DataFrame:
        """All answers, one of each pair, though two runs at a time may both have asked."""
        parts = [self.log.read_part(p) for p in self.log.last()["parts"]]
        if not parts:
            return self.log.spark.createDataFrame([], self.SCHEMA)
        return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).dropDuplicates(["key"])

    def outputs(self, grid: DataFrame, chat: Callable[[str, str], dict], concurrency: int = 8, attempts: int = 3, wait: float = 0.5) -> DataFrame:
        """As ``call_models``: the outputs of every row of ``grid`` (prompt_id, idx, model, case_id, prompt), asking for the pairs that are new.

        A worker has ``concurrency`` calls open at a time. A call that raises is tried ``attempts`` times in all, after
        ``wait`` seconds and twice as long each time. A null model or prompt has no output.
        """
        key = F.sha2(F.concat_ws("\0", "model", "prompt"), 256)
        grid = grid.where("model is not null and prompt is not null").withColumn("key", key)
        new = grid.select("key", "model", "prompt").dropDuplicates(["key"]).join(self.answers().select("key"), "key", "left_anti")
        schema = "key string, model string, prompt string, content string, prompt_tokens long, completion_tokens long, latency_ms double"

        def ask(row) -> tuple | None:
            for i in range(attempts):
                try:
                    got = chat(row.model, row.prompt)
                    return (*row, got.get("content"), got.get("prompt_tokens"), got.get("completion_tokens"), got.get("latency_ms"))
                except Exception:  # noqa: BLE001  whatever the user's function raises is a failed call
                    if i + 1 < attempts:
                        time.sleep(wait * 2**i)
            return None

        def run(batches):
            with ThreadPoolExecutor(concurrency) as pool:
                for pdf in batches:
                    rows = [r for r in pool.map(ask, pdf[["key", "model", "prompt"]].itertuples(index=False)) if r]
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                    yield out.astype({"prompt_tokens": "Int64", "completion_tokens": "Int64", "latency_ms": "Float64"})

        got = new.mapInPandas(run, schema)
        for count, of in (("prompt_tokens", "prompt"), ("completion_tokens", "content")):
            got = got.withColumn(count, F.coalesce(count, F.expr(est_tokens(of))))
        folder = self.log.write_part(got.drop("prompt"))

        def change(m: dict) -> dict:
            return {**m, "parts": [*m["parts"], {"folder": folder}]}

        if len(self.log.commit(change)["parts"]) > COMPACT_AT:
            self.log.commit(lambda m: {**m, "parts": [{"folder": self.log.write_part(self.answers())}]})
            self.log.vacuum()
        return grid.drop("prompt").join(self.answers().drop("model"), "key").drop("key")


def grade(grid: DataFrame, checks: DataFrame, patterns: list[str]) -> DataFrame:
    """Grade every cell by its case's checks (case_id, kind, arg, n). A cell without output fails them all. Returns one row per cell."""
    low = "lower(content)"
    regex = " ".join(f"when arg = {SPARK.lit(p)} then content rlike {SPARK.lit('(?i)' + p)}" for p in patterns) or "when false then false"
    ok = f"""case when content is null then false when kind = 'json_valid' then fields is not null when kind = 'has_field' then coalesce(array_contains(fields, arg), false)
        when kind = 'contains' then contains({low}, lower(arg)) when kind = 'not_contains' then not contains({low}, lower(arg))
        when kind = 'regex' then case {regex} else false end when kind = 'max_tokens' then {est_tokens('content')} <= n
        when kind = 'refuses' then {X.has(SPARK, low, L.REFUSALS)} else false end"""
    keys = ["prompt_id", "idx", "model", "case_id"]
    each = grid.withColumn("fields", json_fields("content")).join(sized(checks, SUITE_ROWS), "case_id", "left").withColumn("ok", F.expr(ok))
    schema = F.col("kind").isin(*SCHEMA_CHECKS)
    got = each.groupBy(*keys).agg(
        F.count_if("ok").alias("checks_passed"), F.count("kind").alias("checks_total"), F.count_if(F.col("ok") & schema).alias("schema_passed"), F.count_if(schema).alias("schema_total"),
        F.first("called").alias("called"), F.first("latency_ms").alias("latency_ms"), F.first("cost_usd").alias("cost_usd"),
        F.array_sort(F.collect_list(F.when(~F.col("ok") & F.col("kind").isNotNull(), F.concat_ws(" ", "kind", "arg")))).alias("failures"),
    )
    return got.withColumn("pass", F.expr("checks_total > 0 and checks_passed = checks_total"))


def per_model(graded: DataFrame) -> DataFrame:
    return graded.groupBy("prompt_id", "idx", "model").agg(F.expr("cast(count_if(pass) as double) / count(*)").alias("accuracy"))


def aggregate(graded: DataFrame, static: DataFrame) -> DataFrame:
    """A measured score per candidate. ``static`` (prompt_id, idx, tokens and the objectives) keeps what isn't measured.

    A candidate without cells keeps its row: accuracy 0, no cost, no latency, its static schema validity.
    """
    by_model = per_model(graded).groupBy("prompt_id", "idx").agg(
        F.expr("case when count(*) < 2 then 1D else greatest(0D, least(1D, 1D - 2D * stddev_pop(accuracy))) end").alias("_stability"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "accuracy")))).alias("model_accuracy"),
    )
    own = graded.groupBy("prompt_id", "idx").agg(
        F.expr("cast(count_if(pass) as double) / count(*)").alias("_accuracy"), F.expr("sum(schema_passed) / nullif(sum(schema_total), 0)").alias("_schema"),
        F.avg("latency_ms").alias("mean_latency_ms"), F.sum("cost_usd").alias("total_cost_usd"), F.avg("cost_usd").alias("est_cost"),
    )
    df = static.join(own, ["prompt_id", "idx"], "left").join(by_model, ["prompt_id", "idx"], "left")
    df = df.fillna(0.0, ["_accuracy", "mean_latency_ms", "total_cost_usd", "est_cost"]).fillna(1.0, ["_stability"])
    df = df.withColumn("accuracy", F.col("_accuracy")).withColumn("schema_validity", F.coalesce("_schema", "schema_validity"))
    df = df.withColumn("cross_model_stability", F.col("_stability")).withColumn("latency_efficiency", 1 / (1 + F.col("mean_latency_ms") / LATENCY_BUDGET))
    return df.withColumn("composite", F.expr(composite())).drop("_accuracy", "_schema", "_stability")


def ranked(scored: DataFrame) -> DataFrame:
    """Candidates of a prompt by measured composite; rank 1 wins."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("composite"), "idx")))


def totals(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), F.count_if("pass").alias("passed"))


def winners(graded: DataFrame, scored: DataFrame) -> DataFrame:
    """Per prompt of ``scored`` (ranked, with label): calls, their cost, and the label of the candidate of rank 1 (empty without one)."""
    calls = graded.groupBy("prompt_id").agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    first = scored.groupBy("prompt_id").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("winner"))
    return first.join(calls, "prompt_id", "left").select("prompt_id", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("winner", F.lit("")).alias("winner"))
