"""Ambiguity and safety findings. Steps read ``text``, ``lc``, ``lines``, ``constraints`` (and the lines in lower case that go with them), ``words`` and ``sections``."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import Dialect, Steps


def _issue(d: Dialect, severity: str, code: str, snippet: str = "''", line: str = "0") -> str:
    return d.struct(severity=d.lit(severity), code=d.lit(code), snippet=snippet, line=f"cast({line} as int)")


def _if(d: Dialect, test: str, issue: str) -> str:
    """One finding or none."""
    return d.keep(d.array(issue), "z", test)


def vague_term(d: Dialect, s: str) -> str:
    """The first vague term, in list order, that the line ``s`` has as a word (terms with a space: anywhere). ``vp``: those that the whole text has."""
    whens = []
    for term in L.VAGUE:
        test = d.contains(s, term)
        if " " not in term:
            test = f"{test} and {d.matches(s, f'(?:^|[^a-z0-9_]){X.quote(term)}(?:$|[^a-z0-9_])')}"
        whens.append(f"when {test} then {d.lit(term)}")
    return f"case when not {X.part_has(d, s, L.VAGUE, 'vp')} then null {' '.join(whens)} end"


def ambiguity(d: Dialect) -> Steps:
    terms = d.map("lines", "x, i", d.struct(line="i", raw="x", term=d.let(X.lower(d, "x"), "v", vague_term(d, "v"))))
    if d.name == "spark":
        terms = d.map("lines", "x, i", d.struct(line="i", raw="x", term=d.let(d.at("ll", "i"), "v", vague_term(d, "v"))))
        terms = d.let(X.present(d, L.VAGUE), "vp", d.let("_lowered", "ll", terms))
    vague = d.gate(terms, X.has(d, "lc", L.VAGUE))
    per_line = d.map(d.keep("_vague", "x", "x.term is not null"), "x", _issue(d, "warn", "AMB001", f"substring({X.trim(d, 'x.raw')}, 1, 120)", "x.line"))
    start = d.let(f"substring({X.trim(d, 'text', long=True)}, 1, {max(map(len, L.UNDEFINED_OPENERS))})", "t", X.lower(d, "t"))
    opener = d.let(start, "o", " or ".join(d.starts("o", w) for w in L.UNDEFINED_OPENERS))
    unclear = f"not ({X.has(d, 'lc', L.CRITERIA)} or n_constraints > 0) and words > 12"
    return [
        ("_vague", vague),
        ("ambiguities", d.concat_arrays(
            per_line,
            _if(d, f"({opener})", _issue(d, "warn", "AMB002", f"substring({X.trim(d, 'text', long=True)}, 1, 80)")),
            _if(d, f"{X.has(d, 'lc', L.LONG_GOALS)} and {X.has(d, 'lc', L.SHORT_GOALS)}", _issue(d, "warn", "AMB003")),
            _if(d, unclear, _issue(d, "info", "AMB004")))),
        ("n_ambiguities", d.size("ambiguities")),
        ("clarity", X.clamp(f"(cast(1 as double) - {_penalty(d, 'ambiguities', L.CLARITY_PENALTY)} / (cast(1 as double) + cast(words as double) / cast(100 as double)))")),
    ]


def _penalty(d: Dialect, issues: str, prices: dict[str, float]) -> str:
    price = f"case x.severity when 'error' then {X.num(prices['error'])} when 'warn' then {X.num(prices['warn'])} else {X.num(prices['info'])} end"
    return d.sum(d.map(issues, "x", price), "cast(0 as double)")


def mixed_at_all(d: Dialect, groups) -> str:
    """The whole text has words of two or more of the groups: a section has no words that it lacks."""
    return f"(({' + '.join(f'case when {X.has(d, "lc", g)} then 1 else 0 end' for g in groups)}) >= 2)"


def mixed(d: Dialect, groups, tokens: int, sections: str = "sections") -> str:
    """Some section of more than ``tokens`` tokens has words of two or more of the groups."""
    votes = " + ".join(f"case when {X.has(d, 'lw', g)} then 1 else 0 end" for g in groups)
    many = d.let(X.lower(d, "x.content"), "lw", f"({votes}) >= 2")
    some = d.any(sections, "x", f"x.tokens > {tokens} and {many}")
    return f"({mixed_at_all(d, groups)} and {some})" if d.name == "spark" else some


def safety(d: Dialect) -> Steps:
    override = d.gate(d.keep(d.map("lines", "x, i", d.struct(line="i", raw="x")), "x", X.has(d, X.lower(d, "x.raw"), L.OVERRIDES)), X.has(d, "lc", L.OVERRIDES))
    policy = f"({d.any('sections', 'x', f'x.kind = {d.lit("Policy")}')} or {X.has(d, 'lc', L.POLICY_WORDS)})"
    return [
        ("safety", d.concat_arrays(
            d.map(override, "x", _issue(d, "error", "SAFE001", "substring(x.raw, 1, 120)", "x.line")),
            _if(d, f"{X.has(d, 'lc', L.PLACEHOLDERS)} and not {X.has(d, 'lc', L.DELIMITERS)}", _issue(d, "warn", "SAFE002")),
            _if(d, f"{X.has(d, 'lc', L.TOOL_WORDS)} and not {policy}", _issue(d, "warn", "SAFE003")),
            _if(d, mixed(d, L.MIXED, 40), _issue(d, "warn", "SAFE004")),
            _if(d, f"{X.has(d, 'lc', L.SENSITIVE)} and not {X.has(d, 'lc', L.HANDLING)}", _issue(d, "info", "SAFE005")))),
        ("safety_margin", X.clamp(f"(cast(1 as double) - {_penalty(d, 'safety', L.SAFETY_PENALTY)})")),
    ]
