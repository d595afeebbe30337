"""Intent, constraints, sections and schema of a prompt. Steps read ``text`` and ``lc`` (its lower case)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.dialect import Dialect, Steps


def basics(d: Dialect) -> Steps:
    return [("lc", X.lower(d, "text")), ("tokens", X.tokens(d, "text")), ("chars", "cast(length(text) as bigint)"), ("words", X.words(d, "text"))]


def intent(d: Dialect) -> Steps:
    hits = [f"({' + '.join(f'case when {d.contains("lc", w)} then 1 else 0 end' for w in words)})" for _, words in L.TASKS]
    names, position = d.array(*(d.lit(name) for name, _ in L.TASKS)), "array_position" if d.name == "spark" else "list_position"
    confidence = f"case when hits = 0 then {X.num(0.4)} when hits = 1 then {X.num(0.7)} else {X.num(0.85)} end"
    confidence = f"({confidence} + case when output_type <> 'unknown' then {X.num(0.1)} else {X.num(0)} end + case when audience <> 'general' then {X.num(0.05)} else {X.num(0)} end)"
    return [
        ("_hits", d.array(*hits)),
        ("hits", f"{'array_max' if d.name == 'spark' else 'list_max'}(_hits)"),
        ("task_type", f"case when hits = 0 then 'generate' else {d.at(names, f'({position}(_hits, hits) - 1)')} end"),
        ("output_type", X.first(d, "lc", L.OUTPUTS, "'unknown'")),
        ("audience", X.first(d, "lc", L.AUDIENCES, "'general'")),
        ("confidence", X.clamp(confidence)),
    ]


def lines(d: Dialect) -> Steps:
    return [("lines", X.lines(d, "text"))]


def constraints(d: Dialect, low: str = "lc") -> Steps:
    """``constraints``: array of (polarity, text, category, line), repeats (but for case) dropped. Needs ``lines``; ``low``: the text in lower case."""
    any_word = tuple(w for _, _, words in L.POLARITIES for w in words)
    cleaned = d.replace_all("x", f"^[-*•0-9.){X.WS}]+", "")
    clauses = d.flatten(d.map("lines", "x, i", d.map(d.split(cleaned, "[.;]"), "c", d.struct(c=X.trim(d, "c"), line="cast(i as int)"))))
    if d.name == "spark":  # a line without any of the words has no clause with one
        numbered = d.let("_lowered", "ll", d.map("lines", "x, i", d.struct(x="x", l=d.at("ll", "i"), i="i")))
        telling = d.keep(numbered, "y", d.any("aw", "w", "contains(y.l, w)"))
        clauses = d.flatten(d.map(telling, "y", d.map(d.split(cleaned.replace("(x,", "(y.x,"), "[.;]"), "c", d.struct(c=X.trim(d, "c", long=True), line="cast(y.i as int)"))))
    polarity = "case " + " ".join(f"when {X.part_has(d, 'x.l', words, f'pw.{name}')} then {d.lit(name)}" for name, _, words in L.POLARITIES) + " end"
    weak = ", ".join(d.lit(name) for name, strength, _ in L.POLARITIES if strength < 2)
    category = X.first(d, "x.l", L.CATEGORIES, "'general'")
    position = "array_position" if d.name == "spark" else "list_position"
    said = d.replace_all("x.c", f"[{X.WS}]+", " ")
    lowered = d.map(d.keep(clauses, "x", f"{d.bytes('x.c')} >= 3"), "x", d.struct(c="x.c", l=X.lower(d, "x.c"), line="x.line"))
    judged = d.map(lowered, "x", d.struct(c="x.c", l="x.l", line="x.line", polarity=polarity))
    if d.name == "spark":
        of = {name: d.common(d.array(*map(d.lit, words)), "aw") for name, _, words in L.POLARITIES}
        judged = d.let(X.present(d, any_word, low), "aw", d.let(d.struct(**of), "pw", judged))
    polar = d.keep(judged, "x", f"x.polarity is not null and not ({X.words(d, 'x.c')} < 2 and x.polarity in ({weak}))")
    return [
        *([("_lowered", X.lines(d, low))] if d.name == "spark" else []),
        ("_polar", d.gate(polar, X.has(d, low, any_word))),
        ("_ruled", d.map("_polar", "x", d.struct(polarity="x.polarity", text=said, category=category, line="x.line", l=X.lower(d, said)))),
        ("_seen", d.map("_ruled", "x", "x.l")),
        ("constraints", d.map(d.let("_seen", "seen", d.keep("_ruled", "x, i", f"{position}(seen, x.l) = i + 1")), "x", d.struct(polarity="x.polarity", text="x.text", category="x.category", line="x.line"))),
        ("n_constraints", d.size("constraints")),
    ]


def _trimmed_marks(d: Dialect, s: str) -> str:
    bare = X.trim(d, d.replace_all(s, "^#+", ""))
    bare = X.trim(d, d.replace_all(bare, "^(?:- )+", ""))
    return d.replace_all(bare, "^[*_`]+|[*_`]+$", "")


def sections(d: Dialect, known: str | None = None) -> Steps:
    """``sections``: array of (kind, title, content, tokens, start_line, end_line). Needs ``lines``; ``known``: the column with the whole text's tokens.

    A heading is a markdown heading or a short label with a colon whose words
    name a kind; it opens a section up to the next one. Lines of a fence are
    never headings. Blank lines that lead a section are skipped.
    """
    label = "case when x.md then " + d.replace_all("x.t", ":+$", "") + " when " + d.contains("x.t", ":") + f" then {d.extract('x.t', '^([^:]*):', 1)} end"
    fits = f"(x.md or ({d.bytes('x.label')} <= 24 and x.label <> '' and {X.words(d, 'x.label')} <= 3))"
    kind = X.first(d, X.trim(d, X.lower(d, "x.label")), L.HEADINGS, "null")
    fences = d.size(d.keep(d.slice("fs", "0", "i"), "f", "f"))
    n = d.size("lines")
    ends = d.at("bs", "i + 1")
    position = "array_position" if d.name == "spark" else "list_position"
    lead = f"coalesce(nullif({position}({d.map('x.body', 'y', f'{X.trim(d, chr(121), long=True)} = {chr(39) * 2}')}, false), 0) - 1, {d.size('x.body')})"
    trimmed = X.trim(d, "x.content", long=True)
    opener = d.extract("lw", f"^[{X.WS}]*([^{X.WS}]+)", 1)
    verbs = ", ".join(d.lit(v) for v in L.IMPERATIVES)
    by_content = f"""case when {d.starts(trimmed, '{')} and {d.matches(trimmed, '[}]$')} then 'Output'
        when {d.starts('lw', 'you are ')} or {X.has(d, 'lw', L.BLOCK_ROLE)} then 'Role' when {X.has(d, 'lw', L.BLOCK_OUTPUT)} then 'Output'
        when {X.has(d, 'lw', L.BLOCK_CONSTRAINTS)} then 'Constraints' when {X.has(d, 'lw', L.BLOCK_EXAMPLES)} then 'Examples'
        when {opener} in ({verbs}) then 'Task' else 'Unknown' end"""
    by_content = d.let(X.lower(d, "x.content"), "lw", by_content)
    tokens = X.tokens(d, "x.content")
    if known and d.name == "spark":  # without headings a section is the whole text more often than not
        tokens = f"if(x.content = text, {known}, {tokens})"
    return [
        ("_raw", d.map("lines", "x", X.trim(d, "x", long=True))),
        ("_fences", d.map("_raw", "x", d.starts("x", "```"))),
        ("_fenced", d.any("_fences", "f", "f")),
        ("_marks", d.map("_raw", "x", d.struct(raw="x", md=d.starts("x", "#"), t=f"case when {d.starts('x', '#')} or {d.contains('x', ':')} then {_trimmed_marks(d, 'x')} end"))),
        ("_labels", d.map("_marks", "x", d.struct(raw="x.raw", md="x.md", t="x.t", label=label))),
        ("_kinds", d.let("_fences", "fs", d.map("_labels", "x, i", f"case when x.raw = '' or x.label is null or {d.at('fs', 'i')} then null when _fenced and {fences} % 2 = 1 then null when {fits} then {kind} end"))),
        ("_heads", d.let("_kinds", "ks", d.keep(d.range(n), "k", f"{d.at('ks', 'k')} is not null"))),
        ("_starts", d.concat_arrays(d.array("cast(-1 as bigint)"), "_heads")),
        ("_bounds", d.concat_arrays("_starts", d.array(n))),
        ("_bodies", d.let("_bounds", "bs", d.let("lines", "ls", d.map("_starts", "x, i", d.struct(s="x", e=ends, body=d.slice("ls", "x + 1", f"{ends} - x - 1")))))),
        ("_lead", d.map("_bodies", "x", d.struct(s="x.s", e="x.e", body="x.body", lead=f"cast({lead} as bigint)"))),
        ("_texts", d.map("_lead", "x", d.struct(s="x.s", e="x.e", lead="x.lead", content=d.join(d.slice("x.body", "x.lead", f"{d.size('x.body')} - x.lead"), "\n")))),
        ("sections", d.let("_kinds", "ks", d.let("_labels", "ts", d.map(d.keep("_texts", "x", f"x.s >= 0 or {trimmed} <> ''"), "x", d.struct(
            kind=f"case when x.s >= 0 then {d.at('ks', 'x.s')} else {by_content} end",
            title=f"case when x.s < 0 then '' when {d.at('ts', 'x.s')}.md then {d.at('ts', 'x.s')}.t else {d.at('ts', 'x.s')}.raw end",
            content=X.trim_end(d, "x.content"), tokens=tokens,
            start_line="cast(case when x.lead > 0 or x.s < 0 then x.s + 1 + x.lead else x.s end as int)", end_line="cast(greatest(0, x.e - 1) as int)"))))),
    ]


# ---- schema

TYPE_WORDS = ("string", "number", "boolean", "integer", "float", "any", "object")


def _fields(**values: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def first_block(text: str) -> str:
    """The balanced {...} that begins at the first brace of a text; null if that brace never closes."""
    return _block(text, "a.n = 0", "1")


def largest_block(text: str) -> str:
    """The largest balanced {...} of a text, in bytes; of equal ones the first; null if there is none. A brace that never closes is passed over."""
    return _block(text, "x.n + a.p - a.s > a.n", "size(ps)")


def _block(text: str, better: str, tries: str) -> str:
    """Of the balanced blocks the last that was ``better`` than the one before. ``tries``: so many braces that don't close are passed over.

    Within quotes braces don't count and a backslash escapes. The text from the
    first opening to the last closing brace is cut after every quote, brace and backslash, and the pieces are folded with what is
    open; all blocks up to the first brace that doesn't close take one pass, each such brace one more.
    """
    core = f"regexp_extract({text}, '(?s)\\\\{{.*\\\\}}', 0)"
    pieces = "transform(regexp_extract_all(c, '[^\\\\\\\\\"{}]*+[\\\\\\\\\"{}]', 0), x -> named_struct('mark', substring(x, -1, 1), 'n', cast(octet_length(x) as bigint)))"
    mark, at = "x.mark", "a.p + x.n - 1"
    free, plain = "a.s < 0", "not a.q"
    closes = f"a.s >= 0 and {plain} and a.d = 1 and {mark} = '}}'"
    opens = f"{free} and {mark} = '{{' and {at} >= a.f"
    larger = f"{closes} and {better}"
    escaped = "a.e and x.n = 1"
    after = _fields(
        p="a.p + x.n", f="a.f",
        s=f"case when {opens} then {at} when {closes} then -1L else a.s end",
        d=f"case when {free} or a.q then if({opens}, 1, a.d) when {mark} = '{{' then a.d + 1 when {mark} = '}}' then a.d - 1 else a.d end",
        q=f"case when {free} then false when a.q then {escaped} or {mark} <> '\"' else {mark} = '\"' end",
        e=f"a.s >= 0 and a.q and not ({escaped}) and {mark} = '\\\\'",
        b=f"if({larger}, a.s, a.b)", n=f"if({larger}, {at} + 1 - a.s, a.n)",
    )
    fresh = _fields(p="0L", f="o.f", s="-1L", d="0", q="false", e="false", b="o.b", n="o.n")
    ended = _fields(f="if(a.s < 0, -1L, a.s + 1)", b="a.b", n="a.n")
    once = f"aggregate(ps, {fresh}, (a, x) -> {after}, a -> {ended})"
    braces = f"slice(filter(ps, x -> x.mark = '{{'), 1, {tries})"
    best = f"aggregate({braces}, {_fields(f='0L', b='-1L', n='0L')}, (o, y) -> if(o.f < 0, o, {once}))"
    cut = f"transform(array({best}), z -> if(z.b < 0, null, cast(substring(cast(c as binary), cast(z.b + 1 as int), cast(z.n as int)) as string)))[0]"
    return f"if(contains({text}, '{{'), transform(array({core}), c -> transform(array({pieces}), ps -> {cut})[0])[0], null)"


def without_placeholders(block: str) -> str:
    """``<...>`` and ``...`` outside quotes, and type words that stand for a value, become null."""
    skipped = r'(?:[^"<.]++|"(?:[^"\\\\]++|\\\\.)*+(?:"|\\z)|<(?![^>]*>)|\\.(?!\\.\\.))*+'
    marks = f"regexp_replace({block}, '(?s)\\\\G({skipped})(?:<[^>]*>|\\\\.\\\\.\\\\.)', '$1null')"
    return f"regexp_replace({marks}, ': (?:{'|'.join(TYPE_WORDS)})(?=[,}} \\n])', ': null')"


_STRICT = "'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false'"


def parses(block: str) -> str:
    """The text of an object is JSON as the standard has it (repeated keys pass; at most 1000 levels). ``block`` isn't null."""
    return f"from_json({block}, '_bad string', map('columnNameOfCorruptRecord', '_bad', {_STRICT}))._bad is null"


def keys(block: str) -> str:
    """The keys of the text of an object; null if it isn't JSON."""
    return f"map_keys(from_json({block}, 'map<string, string>', map({_STRICT})))"


def with_schema(df):
    """``schema``: (present, valid, kind) of the text, and ``schema_score``. No step leaves the JVM."""
    df = df.withColumn("_block", F.expr(largest_block("text")))
    valid = f"_block is not null and {parses(without_placeholders('_block'))}"
    kind = "if(_block is not null or lc rlike 'json|valid object|schema', 'json', 'none')"
    df = df.withColumn("schema", F.expr(_fields(present="_block is not null", valid=valid, kind=kind))).drop("_block")
    s = F.col("schema")
    return df.withColumn("schema_score", F.when(s["valid"], 1.0).when(s["present"], 0.4).when(s["kind"] == "json", 0.0).otherwise(0.6))
