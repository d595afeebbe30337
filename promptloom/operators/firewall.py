"""The prompt firewall: findings, risk components and decision; secret tokens and scrubbing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import SPARK, Dialect, Steps, apply
from . import lint, parse

#: What ends a token in which secrets are looked for.
BREAKS = rf"{X.WS}\"'=,;()<>"
CONTEXT = ("data_sensitivity", "tool_power", "external_destination", "model_uncertainty", "prior_failure_similarity")
DEFAULT_UNCERTAINTY = 0.2


#: What a text with a secret has somewhere: as it is, or in lower case.
SHAPES, LOW_SHAPES = ("sk-", "ghp_", "gho_", "github_pat_", "AKIA", "ASIA", "xoxb-", "xoxp-", "AIza", "eyJ"), ("sk_", "canary")


def secret_kind(d: Dialect, t: str) -> str:
    """The first shape that the token has, or null."""
    low = X.lower(d, t)
    s = lambda *p: "(" + " or ".join(d.starts(t, x) for x in p) + ")"
    return f"""case when {s('sk-')} or {d.starts(low, 'sk_')} or {d.contains(low, 'sk_test_')} then 'openai-style key'
        when {s('ghp_', 'gho_', 'github_pat_')} then 'github token' when {s('AKIA', 'ASIA')} then 'aws access key id'
        when {d.contains(low, 'canary')} and {d.bytes(t)} >= 8 then 'seeded canary' when {s('xoxb-', 'xoxp-')} then 'slack token'
        when {s('AIza')} then 'google api key' when {s('eyJ')} and {d.contains(t, '.')} then 'jwt' end"""


def secrets(d: Dialect) -> Steps:
    """``secrets``: (kind, snippet) of every token of at least 8 bytes that has a secret's shape. Reads ``lc``."""
    runs = d.gate(d.keep(d.extract_all("text", f"[^{BREAKS}]+"), "x", f"{d.bytes('x')} >= 8"), f"({X.has(d, 'text', SHAPES)} or {X.has(d, 'lc', LOW_SHAPES)})")
    return [("_tokens", d.map(runs, "x", d.struct(t="x", kind=secret_kind(d, "x")))), ("secrets", d.map(d.keep("_tokens", "x", "x.kind is not null"), "x", d.struct(kind="x.kind", snippet=f"concat(substring(x.t, 1, 4), {d.lit('…[REDACTED]')})")))]


def scrub(d: Dialect) -> Steps:
    """``scrubbed`` and ``redactions``; tokens of any length count."""
    parts = d.extract_all("text", f"[^{BREAKS}]+|[{BREAKS}]+")
    return [
        ("_parts", d.map(parts, "x", d.struct(t="x", hit=f"({secret_kind(d, 'x')}) is not null"))),
        ("scrubbed", d.join(d.map("_parts", "x", "case when x.hit then '[REDACTED]' else x.t end"), "")),
        ("redactions", d.size(d.keep("_parts", "x", "x.hit"))),
    ]


def firewall(d: Dialect) -> Steps:
    """Reads text, lc, lines, sections, secrets and the context columns ``ctx_*`` (null: not provided).

    A context value takes the place of the estimate and of its findings.
    """
    n, has = X.num, lambda words, s="lc": X.has(d, s, words)
    given = {c: f"(ctx_{c} is not null and not isnan(ctx_{c}) and ctx_{c} >= 0)" for c in CONTEXT[:3]}
    low = X.lower(d, "x")
    find = lambda code, severity, snippet="''": d.struct(code=d.lit(code), severity=d.lit(severity), snippet=f"substring({snippet}, 1, 120)")
    one = lambda test, item: d.keep(d.array(item), "z", test)
    sane = lambda c, default: f"case when ctx_{c} is null then {n(default)} when isnan(ctx_{c}) or abs(ctx_{c}) = cast('Infinity' as double) then {n(0)} else {X.clamp(f'ctx_{c}')} end"
    risk = " + ".join(f"{n(w)} * {c}" for c, w, _ in L.RISK_WEIGHTS)
    ranked = d.array(*(d.struct(neg=f"(- {n(w)} * {c})", i=str(i), name=d.lit(label)) for i, (c, w, label) in enumerate(L.RISK_WEIGHTS)))
    return [
        ("_injected", d.gate(d.keep("lines", "x", has(L.INJECTIONS, low)), has(L.INJECTIONS))),
        ("_bare", f"({has(L.RISK_PLACEHOLDERS)} and not {has(L.RISK_DELIMITERS)})"),
        *_parts(d),
        ("_confused", lint.mixed(d, L.RISK_MIXED, 30, "_some_sections" if d.name == "spark" else "sections")),
        ("_leak", f"({has(L.FORWARDING)} and {d.size('secrets')} > 0)"),
        ("_destroys", f"case when {given['tool_power']} then null else {d.at(d.gate(d.keep('lines', 'x', f'{has(L.DESTRUCTIVE, low)} and not {has(L.FRAMING, low)}'), has(L.DESTRUCTIVE)), '0')} end"),
        ("_delegates", f"(not {given['tool_power']} and {has(L.DELEGATION)})"),
        ("_leaves", f"(not {given['external_destination']} and {has(L.EXTERNAL)})"),
        ("findings", d.concat_arrays(
            d.map("_injected", "x", find("PI", "error", "x")), one("_bare", find("RD", "warn")), one("_confused", find("PC", "warn")),
            d.map("secrets", "x", find("SX", "error", "x.snippet")), one("_leak", find("LG", "error")),
            one("_destroys is not null", find("TA", "error", "_destroys")), one("_delegates", find("AC", "info")), one("_leaves", find("EX", "warn")))),
        ("data_sensitivity", X.clamp(f"greatest(case when {given['data_sensitivity']} then ctx_data_sensitivity when {d.size('secrets')} > 0 then {n(0.85)} when {has(L.PRIVATE)} then {n(0.6)} else {n(0)} end, case when _leak then {n(0.95)} else {n(0)} end)")),
        ("tool_power", X.clamp(f"case when {given['tool_power']} then ctx_tool_power when _destroys is not null then {n(0.8)} when _delegates then {n(0.55)} when {has(L.NETWORK)} then {n(0.5)} else {n(0)} end")),
        ("instruction_conflict", f"case when {d.size('_injected')} > 0 then {n(0.9)} when _bare then {n(0.5)} when _confused then {n(0.45)} else {n(0)} end"),
        ("external_destination", X.clamp(f"case when {given['external_destination']} then ctx_external_destination when _leaves then {n(0.7)} else {n(0)} end")),
        ("model_uncertainty", sane("model_uncertainty", DEFAULT_UNCERTAINTY)),
        ("prior_failure_similarity", sane("prior_failure_similarity", 0.0)),
        ("_floor", f"""case when ({d.size('secrets')} > 0 and _leaves) or _leak then {n(0.82)} when _destroys is not null and {has(L.AUTO_EXECUTE)} then {n(0.82)}
            when {d.size('_injected')} > 0 or {d.size('secrets')} > 0 or _destroys is not null then {n(0.62)} else {n(0)} end"""),
        ("risk", f"greatest({X.clamp(f'({risk})')}, _floor)"),
        ("decision", f"case when risk < {n(0.3)} then 'allow' when risk < {n(0.6)} then 'allow_with_logging' when risk < {n(0.8)} then 'require_approval' else 'block' end"),
        ("create_incident", "(decision = 'block')"),
        ("dominant", d.join(d.map(d.keep(d.slice(d.sorted(ranked), "0", "2"), "x", "x.neg < 0"), "x", "x.name"), ", ")),
    ]


_PRIVATE_NAME = re.compile(r"\b_(?=[a-z])|\bsections\b|\blines\b")


def _parts(d: Dialect) -> Steps:
    """``_sections``: the sections of a text with words of two or more groups, the only ones that are looked at."""
    if d.name != "spark":
        return []
    own = lambda s: _PRIVATE_NAME.sub(lambda m: "_some_" + m.group().strip("_"), s)
    return [("_some_lines", d.gate("lines", lint.mixed_at_all(d, L.RISK_MIXED))), *((own(name), own(expression)) for name, expression in parse.sections(d))]


def assess(df: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """Add the firewall's columns to a frame with ``text``. ``context``: a column name for each context value that is provided (-1 or null: not provided)."""
    context = context or {}
    for c in CONTEXT:
        df = df.withColumn(f"ctx_{c}", F.col(context[c]).cast("double") if c in context else F.lit(None).cast("double"))
    df = apply(df, [("lc", X.lower(SPARK, "text")), *parse.lines(SPARK), *parse.sections(SPARK), *secrets(SPARK), *firewall(SPARK)])
    shown = F.when(F.col("dominant") == "", "none").otherwise(F.col("dominant"))
    note = F.when(F.col("_floor") > 0, " (critical-pattern escalation)").otherwise("")
    df = df.withColumn("rationale", F.concat(F.lit("risk="), F.format_string("%.2f", "risk"), F.lit(" → "), "decision", note, F.lit(". Dominant factors: "), shown, F.lit(".")))
    return df.drop("lc", "lines", *(c for c in df.columns if c.startswith(("_", "ctx_"))))
