"""Text expressions: lines, trimming, words, membership tests and the token estimate."""

from __future__ import annotations

import re

from .dialect import Dialect

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as Unicode has it, for character classes of either engine.
WS = r"\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters as a literal.
_WS_CODES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_WS_CHARS, _WS_COUNT = "'" + "".join(f"\\u{c:04X}" for c in _WS_CODES) + "'", len(_WS_CODES)
_RUNS = r"[\x00-\x7F]+|[^\x00-\x7F]+"
_SPECIAL = set("\\.^$|?*+()[]{}")


def quote(s: str) -> str:
    """``s`` as a pattern that matches it literally."""
    return "".join("\\" + c if c in _SPECIAL else c for c in s)


def _named(d: Dialect, s: str, name: str, body) -> str:
    """``body`` of ``s``, which is worked out once."""
    return body(s) if re.fullmatch(r"[A-Za-z_][\w.]*", s) else d.let(s, name, body(name))


def lower(d: Dialect, s: str) -> str:
    """Lower case of A-Z only. The engine's lower case does the same, and faster, for a text in ASCII, and for the runs of ASCII of any other."""
    if d.name != "spark":
        return f"translate({s}, '{UPPER}', '{LOWER}')"
    runs = lambda x: f"array_join(transform({d.extract_all(x, _RUNS)}, r_ -> if(ascii(r_) < 128, lower(r_), r_)), '')"
    fast = lambda x: f"if(octet_length({x}) = length({x}), lower({x}), {runs(x)})"
    return _named(d, s, "u_", fast)


def _open_end(s: str) -> str:
    """``s`` may end with white space: no more than its last byte is looked at."""
    return f"substring(cast({s} as binary), -1) not between X'21' and X'7F'"


def trim(d: Dialect, s: str, long: bool = False) -> str:
    """``long``: ``s`` may be a whole text, of which the engine would measure every character."""
    if d.name != "spark":
        return d.replace_all(s, f"^[{WS}]+|[{WS}]+$", "")
    both = lambda x: f"trim(BOTH {_WS_CHARS} FROM {x})"
    return _named(d, s, "e_", lambda x: f"if({_open_end(x)} or ascii({x}) not between 33 and 127, {both(x)}, {x})") if long else both(s)


def trim_end(d: Dialect, s: str) -> str:
    if d.name != "spark":
        return d.replace_all(s, f"[{WS}]+$", "")
    return _named(d, s, "e_", lambda x: f"if({_open_end(x)}, trim(TRAILING {_WS_CHARS} FROM {x}), {x})")


def has(d: Dialect, s: str, words: tuple[str, ...]) -> str:
    """Some word is a substring of ``s``. Plain searches: an alternation would be tried in full at every character."""
    if d.name != "spark":
        return d.matches(s, "|".join(quote(w) for w in words))
    any_of = lambda x: "(" + " or ".join(d.contains(x, w) for w in words) + ")"
    return _named(d, s, "s_", any_of)


def present(d: Dialect, words: tuple[str, ...], low: str = "lc") -> str:
    """Those of ``words`` that the whole text has, in lower case ``low``: only they need to be looked for in its parts."""
    if d.name == "spark":
        return d.let(low, "t_", f"array_compact({d.array(*(f'case when {d.contains("t_", w)} then {d.lit(w)} end' for w in words))})")
    return d.let(low, "t_", d.keep(d.array(*map(d.lit, words)), "w", "contains(t_, w)"))


def part_has(d: Dialect, s: str, words: tuple[str, ...], known: str) -> str:
    """Some word is a substring of ``s``, a part of the whole text. ``known``: the words that are present in that."""
    return d.any(known, "w", f"contains({s}, w)") if d.name == "spark" else has(d, s, words)


def first(d: Dialect, s: str, groups, default: str) -> str:
    """The name of the first group with a word in ``s``."""
    whens = " ".join(f"when {has(d, s, words)} then {d.lit(name)}" for name, words in groups)
    return f"case {whens} else {default} end"


def word_list(d: Dialect, s: str) -> str:
    """White-space separated words."""
    if d.name == "spark":  # splitting at a single character needs no pattern, and plain replacements are faster than translate
        beyond = d.matches(s, r"[\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
        rare = f"(octet_length({s}) <> length({s}) and {beyond} or {d.matches(s, r'[\x0B-\r]')})"
        plain = f"if({rare}, translate({s}, {_WS_CHARS}, '{' ' * _WS_COUNT}'), replace(replace({s}, '\\n', ' '), '\\t', ' '))"
        return f"array_remove(split({plain}, ' ', -1), '')"
    return d.extract_all(s, f"[^{WS}]+")


def words(d: Dialect, s: str) -> str:
    """How many words there are."""
    return d.size(word_list(d, s))


def lines(d: Dialect, s: str) -> str:
    """Lines without their ends; no empty line after a last line break."""
    parts = d.split(s, "\n")
    n = d.size(parts)
    kept = d.slice(parts, "0", f"({n} - case when {d.at(parts, f'({n} - 1)')} = '' then 1 else 0 end)")
    bare = d.map(kept, "x", d.replace_all("x", "\r$", ""))
    return f"if(contains({s}, '\\r'), {bare}, {kept})" if d.name == "spark" else bare


_BLANK, _LETTER = r"[\t-\r ]", "[A-Za-z']"
_SIGN = r"[^\t-\r A-Za-z0-9\x80-\x{10FFFF}]"


def _blank_cost(d: Dialect, x: str) -> str:
    """Tokens of a run of two or more white-space characters."""
    parts = d.split(x, "\n")
    rest = f"(length({d.at(parts, f'({d.size(parts)} - 1)')}) % 4)"
    return f"greatest(1, {d.size(parts)} - 1 + {d.sum(d.map(parts, 'y', 'cast(floor(length(y) / 4) as bigint)'))} + case when {rest} > 0 then 1 else 0 end)"


def _tokens_by_run(d: Dialect, s: str) -> str:
    """The sum over a list of all runs."""
    runs = d.extract_all(s, rf"{_BLANK}{{2,}}|[A-Za-z]{_LETTER}*|[0-9]+|[^\x00-\x7F]|{_SIGN}+")
    n = "length(x)"
    cost = f"""case when ascii(x) between 97 and 122 or ascii(x) between 65 and 90 then case when {n} <= 7 then 1 when {n} <= 12 then 2 when {n} <= 16 then 3 else 3 + floor(({n} - 13) / 4) end
        when ascii(x) in (9, 10, 11, 12, 13, 32) then {_blank_cost(d, "x")}
        when ascii(x) between 48 and 57 then floor(({n} + 2) / 3)
        when ascii(x) >= 128 then 1 else floor(({n} + 1) / 2) end"""
    return d.sum(d.map(runs, "x", f"cast({cost} as bigint)"))


def _tokens_by_pieces(d: Dialect, s: str) -> str:
    """The same without a list: one character is left of every token, and these are counted.

    A token is up to 3 digits, up to 2 signs, a character beyond ASCII, or a piece of a word: its first 7 letters, the next
    5, and 4 at a time from there on. The first 36 letters are matched at once (a group per piece after the first); where a
    match ends within a word that began 36 or more letters before, the next one takes 4 more. Runs of white space have
    a price of their own and are listed only where there are any.
    """
    more = ""
    for size in (4, 4, 4, 4, 4, 4, 5):  # the innermost piece first
        more = f"(?:({_LETTER}){_LETTER}{{0,{size - 1}}}+{more})?+"
    rest = rf"\G(?<={_LETTER})(?={_LETTER})(?<=[A-Za-z]{_LETTER}{{35,70}}){_LETTER}{{1,4}}+"
    piece = rf"{rest}|{_BLANK}*+(?:[A-Za-z]{_LETTER}{{0,6}}+{more}|[0-9]{{1,3}}+|[^\x00-\x7F]|{_SIGN}{{1,2}}+)"
    ended = f"if({_open_end(s)}, trim(TRAILING ' \\t\\n\\u000B\\u000C\\r' FROM {s}), {s})"
    left = d.replace_all(ended, piece, "x" + "".join(f"${i}" for i in range(1, 8)))
    blanks = d.sum(d.map(d.extract_all(s, rf"{_BLANK}{{2,}}"), "x", f"cast({_blank_cost(d, 'x')} as bigint)"))
    return f"(cast(length({left}) as bigint) + if({d.matches(s, rf'{_BLANK}{{2}}')}, {blanks}, 0L))"


def tokens(d: Dialect, s: str) -> str:
    """Estimated sub-word tokens: runs of white space (single ones are free), letters, digits, marks, and other characters one by one."""
    total = _tokens_by_run(d, s)
    if d.name == "spark":  # the step within long words looks back for a letter and would miss it behind so many quotes
        total = f"if({d.contains(s, chr(39) * 30)}, {total}, {_tokens_by_pieces(d, s)})"
    return f"case when {s} is null then null when {s} = '' then cast(0 as bigint) else greatest({total}, cast(1 as bigint)) end"


def count_tokens(column):
    """The token estimate as a column expression."""
    from pyspark.sql import functions as F

    from .dialect import SPARK

    name = column if isinstance(column, str) else column._jc.toString()
    return F.expr(tokens(SPARK, name))


def clamp(x: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), {x}))"


def num(x: float) -> str:
    return f"cast({x} as double)"
