"""Evaluation from end to end: the candidates of the search, their frontier, models' answers, grades, ranks, and what the memory keeps of the winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from . import evaluate, firewall, memory, optimize, score


def measured(
    prompts: DataFrame, models: DataFrame, cases: DataFrame, checks: DataFrame, chat: Callable[[str, str], dict], ledger: evaluate.CallLedger,
    o: score.Options = score.Options(), frontier_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(graded cells, ranked candidates) of prompts (prompt_id, text; ids unique and not null).

    ``models`` (model, prompt_usd, completion_usd), ``cases`` (case_id, input) and ``checks`` (case_id, kind, arg, n) are
    the suite. A candidate's prompt for a case is its text with the input filled in; every distinct prompt is asked once
    per model. Candidates are worked out once and written. ``scored`` has a row for each, with text and rank, also for
    those off the frontier, which aren't asked unless ``frontier_only`` is off.
    """
    found = optimize.listed(optimize.judged(optimize.gathered(prompts.where("text is not null"), o)))
    cands = staged(found.withColumn("idx", F.col("idx").cast("int")), "candidates")
    asked = cands.where("on_frontier") if frontier_only else cands
    sized = memory.sized
    grid = asked.select("prompt_id", "idx", "text").crossJoin(sized(models.select("model"), evaluate.SUITE_ROWS)).crossJoin(sized(cases.select("case_id", "input"), evaluate.SUITE_ROWS))
    grid = grid.select("prompt_id", "idx", "model", "case_id", F.expr(evaluate.build_prompt()).alias("prompt"))
    outputs = ledger.outputs(grid, chat)
    good = evaluate.usable_patterns([r["arg"] for r in checks.where("kind = 'regex' and arg is not null").select("arg").distinct().collect()])
    cells = evaluate.cells(cands.select("prompt_id", "idx", "on_frontier"), models, cases, outputs, frontier_only)
    graded = staged(evaluate.grade(cells, checks, good), "graded")
    return graded, evaluate.ranked(evaluate.aggregate(graded, cands))


def outcomes(scored: DataFrame) -> DataFrame:
    """The winners as the memory takes them: with the firewall's decision on their text, under the id that the text has."""
    won = firewall.assess(scored.where("rank = 1").select("prompt_id", "text", "composite", "accuracy"))
    return won.select(F.col("prompt_id").alias("seq"), F.lit("").alias("id"), "text", "composite", "accuracy", "decision", F.size("findings").alias("n_findings"), F.lit(0.0).alias("token_reduction"))


def remember(scored: DataFrame, known: memory.Backend) -> None:
    """Re-record the winners with what was measured: accepted where their accuracy is high enough."""
    known.upsert(memory.entries(memory.evaluated(outcomes(scored))))
