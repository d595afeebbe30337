"""The seven objectives, the composite, the route hint, Pareto frontier and acceptance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import SPARK, Dialect, Steps, apply
from . import lint, parse, skyline

NAMES = tuple(n for n, _ in L.OBJECTIVES)


@dataclass(frozen=True)
class Options:
    """Defaults are fixed values."""

    token_budget: int = 800
    usd_per_1k: float = 0.003
    ms_per_token: float = 4.0
    witness_key: str = ""
    issued_at: str = ""


def composite(d: Dialect | None = None, of: str = "") -> str:
    """The weighted sum of the objectives, of columns or of the fields of the struct ``of``."""
    return "(" + " + ".join(f"{f'{of}.' if of else ''}{n} * {X.num(w)}" for n, w in L.OBJECTIVES) + ")"


def weights() -> dict[str, float]:
    return dict(L.OBJECTIVES)


def objectives(d: Dialect, o: Options) -> Steps:
    """Reads tokens, words, clarity, schema_score, constraints, confidence, safety_margin."""
    n, one = X.num, "cast(1 as double)"
    cats = d.size(d.distinct(d.map("constraints", "x", "x.category")))
    breadth = f"least(cast({cats} as double) / {n(4)}, {one})"
    depth = f"least(cast(n_constraints as double) / {n(5)}, {one})"
    long_words = d.size(d.keep(X.word_list(d, "text"), "x", f"{d.bytes('x')} > 12"))
    if d.name == "spark":  # of a text in ASCII without a list of all words
        long_words = f"if(octet_length(text) = length(text), {d.size(d.extract_all('text', '[^ \\t-\\r]{13,}+'))}, {long_words})"
    return [
        ("coverage", f"case when n_constraints = 0 then {n(0)} else {n(0.6)} * {breadth} + {n(0.4)} * {depth} end"),
        ("schema_validity", "schema_score"),
        ("token_efficiency", X.clamp(f"({one} / ({one} + cast(tokens as double) / {n(max(1, o.token_budget))}))")),
        ("latency_efficiency", X.clamp(f"(token_efficiency * {n(0.7)} + clarity * {n(0.3)})")),
        ("accuracy", X.clamp(f"({n(0.35)} * clarity + {n(0.25)} * schema_validity + {n(0.2)} * coverage + {n(0.1)} * confidence + {n(0.1)} * case when n_constraints > 0 then {one} else {n(0)} end)")),
        ("cross_model_stability", f"case when words = 0 then schema_validity * {n(0.5)} + {n(0.25)} else {X.clamp(f'({n(0.5)} * clarity + {n(0.4)} * schema_validity + {n(0.1)} - least(cast({long_words} as double) / cast(words as double), {n(0.3)}))')} end"),
        ("explainability", X.clamp(f"({n(0.5)} * clarity + {n(0.5)} * coverage)")),
        ("composite", composite(d)),
        ("est_cost_usd", f"(cast(tokens as double) / {n(1000)} * {n(o.usd_per_1k)})"),
        ("est_latency_ms", f"(cast(tokens as double) * {n(o.ms_per_token)})"),
    ]


def route(d: Dialect) -> Steps:
    n = X.num
    base = " ".join(f"when '{k}' then {n(v)}" for k, v in L.TASK_COMPLEXITY.items())
    value = f"""(case task_type {base} else {n(0.3)} end + least(cast(tokens as double) / {n(2000)}, {n(0.25)}) + least(cast(n_constraints as double) / {n(12)}, {n(0.15)})
        + case when output_type = 'json' then {n(0.1)} else {n(0)} end + least(cast(n_ambiguities as double) / {n(10)}, {n(0.1)}))"""
    tier = "case " + " ".join(f"when complexity < {n(cut)} then '{t}'" for t, cut, _ in L.TIERS if cut) + f" else '{L.TIERS[-1][0]}' end"
    return [("complexity", X.clamp(value)), ("tier", tier), ("needs_reasoning", "(task_type in ('reason', 'code') or complexity > 0.7)")]


def route_examples() -> Column:
    pairs = [x for t, _, models in L.TIERS for x in (F.lit(t), F.array(*map(F.lit, models)))]
    return F.create_map(*pairs)[F.col("tier")]


def without_scratch(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def analyze(df: DataFrame, o: Options = Options(), tokens: str | None = None) -> DataFrame:
    """Add the whole analysis to a frame with ``text``: counts, intent, sections, constraints, findings, schema, score, route.

    Null text gives null counts, lists and findings; blank text is a prompt like any other.
    ``tokens``: the column with the text's tokens, if they are known.
    """
    df = parse.with_schema(df.withColumn("lc", F.expr(X.lower(SPARK, "text"))))  # first, while rows are small: they wait for its answers
    basics = [(name, tokens if tokens and name == "tokens" else step) for name, step in parse.basics(SPARK)]
    df = apply(df, [*basics, *parse.intent(SPARK), *parse.lines(SPARK), *parse.constraints(SPARK), *parse.sections(SPARK, "tokens"), *lint.ambiguity(SPARK), *lint.safety(SPARK)])
    df = apply(df, [*objectives(SPARK, o), *route(SPARK)])
    return without_scratch(df.withColumn("route_examples", route_examples())).drop("lc", "lines", "hits")


def rescore(df: DataFrame) -> DataFrame:
    """Recompute ``composite`` from the seven objectives."""
    return df.withColumn("composite", F.expr(composite()))


def dominates(a: str, b: str) -> str:
    """Struct ``a`` is as good as ``b`` everywhere and better somewhere."""
    no_worse = " and ".join(f"{a}.{n} >= {b}.{n} - {X.num('1e-9')}" for n in NAMES)
    better = " or ".join(f"{a}.{n} > {b}.{n} + {X.num('1e-9')}" for n in NAMES)
    return f"({no_worse} and ({better}))"


def pareto(df: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Add ``on_frontier``: no other candidate of the prompt dominates, however many there are."""
    return skyline.frontier(df, prompt, NAMES)


def rank(df: DataFrame, prompt: str = "prompt_id", index: str = "idx") -> DataFrame:
    """``rank`` from 1 by composite, best first, ties to the earlier candidate."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(prompt).orderBy(F.desc("composite"), index)))


def accepted(candidate: str = "c", base: str = "b") -> str:
    """The candidate beats the baseline and gives up no accuracy, safety or schema validity."""
    kept = " and ".join(f"{candidate}.{n} >= {base}.{n} - {X.num('1e-9')}" for n in ("accuracy", "safety_margin", "schema_validity"))
    return f"({candidate}.composite > {base}.composite + {X.num('1e-6')} and {kept})"


def improved_count(candidate: str = "c", base: str = "b") -> str:
    return "(" + " + ".join(f"case when {candidate}.{n} > {base}.{n} + {X.num('1e-9')} then 1 else 0 end" for n in NAMES) + ")"
