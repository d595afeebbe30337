"""Expressions as SQL text for two engines: the one that runs and the one that checks.

An operator is a list of (column, expression) steps over earlier columns. The
engine applies them with ``apply``; ``ctes`` renders the same steps as common
table expressions for the checking database.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = Sequence[tuple[str, str]]

_ITEM = re.compile(r"\\x\{[0-9A-Fa-f]+\}|\\x[0-9A-Fa-f]{2}|\\[pP](?:\{[^}]*\}|.)|\\.|.", re.S)
_CONTROL = {"\\t": 9, "\\n": 10, "\\f": 12, "\\r": 13}


def _code(item: str) -> int | None:
    """The code point of an item of a character class; None for a property or a class by name."""
    if item in _CONTROL:
        return _CONTROL[item]
    if item.startswith("\\x"):
        return int(item.strip("\\x{}"), 16)
    return ord(item[-1]) if len(item) == 1 or not item[1].isalnum() else None


def _spelled_class(items: list[str]) -> str:
    """What is between the brackets of a class, without ``^``: ASCII characters one by one, which the engine looks up in a table (a range is a test of its own), others behind one range."""
    low, high, rest, i = [], [], [], 0
    while i < len(items):
        first = last = _code(items[i])
        wide = 3 if i + 2 < len(items) and items[i + 1] == "-" else 1
        if wide == 3:
            last = _code(items[i + 2])
        text = "".join(items[i : i + wide])
        if first is None or last is None:
            rest.append(text)
        elif last < 128:
            low += range(first, last + 1)
        else:
            high.append((first, last, text))
        i += wide
    every = "".join(h for _, _, h in high)
    if len(high) > 1:
        every = f"[\\x{{{min(a for a, _, _ in high):X}}}-\\x{{{max(b for _, b, _ in high):X}}}&&[{every}]]"
    return "".join(chr(c) if chr(c).isalnum() else f"\\x{c:02X}" for c in dict.fromkeys(low)) + every + "".join(rest)


def spelled(regex: str) -> str:
    """``regex`` with its character classes in a form that costs the engine one look in a table for an ASCII character. Nested and intersected classes stay."""
    items, out, i = _ITEM.findall(regex), [], 0
    while i < len(items):
        out.append(items[i])
        i += 1
        if out[-1] != "[":
            continue
        if items[i] == "^":
            out.append("^")
            i += 1
        end = i + 1  # a bracket that comes first doesn't close
        while items[end] not in "[]":
            end += 1
        if items[end] == "[" or "&&" in "".join(items[i:end]):
            return regex
        out.append(_spelled_class(items[i:end]))
        i = end
    return "".join(out)


#: Names of whole texts: what is searched for a word is long.
WHOLE = {"text", "lc", "_lc", "lw", "t_"}
#: Characters of prose from the most to the least frequent; what isn't among them is rarer still.
_FREQUENT = " etaoinsrhldcumfgpwybvk"


def probe(word: str) -> str:
    """The end of ``word``, of three characters at least, that begins with its rarest one. The engine compares wherever the first byte of what it looks for is met, which for a frequent one takes most of the search."""
    rank = {c: i for i, c in enumerate(_FREQUENT)}
    at = max(range(max(1, len(word) - 2)), key=lambda i: (rank.get(word[i], len(rank)), -i))
    return word[at:] if rank.get(word[at], len(rank)) >= rank.get(word[0], len(rank)) + 3 else word


class Dialect:
    """Spark SQL."""

    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def pattern(self, regex: str) -> str:
        return self.lit(spelled(regex))

    def lam(self, names: str, body: str) -> str:
        return f"({names}) -> {body}" if "," in names else f"{names} -> {body}"

    def map(self, arr: str, names: str, body: str) -> str:
        """``names``: "x" or "x, i"; i counts from 0."""
        return f"transform({arr}, {self.lam(names, body)})"

    def keep(self, arr: str, names: str, body: str) -> str:
        return f"filter({arr}, {self.lam(names, body)})"

    def any(self, arr: str, name: str, body: str) -> str:
        return f"exists({arr}, {name} -> {body})"

    def gate(self, arr: str, test: str) -> str:
        """``arr``, or an empty one, for which ``arr`` isn't worked out, where ``test``, which holds for the whole row if it holds for any element, fails."""
        return f"(case {self.let(test, 'ok_', 'ok_')} when true then {arr} when false then array() end)"

    def let(self, value: str, name: str, body: str) -> str:
        """``body`` with ``name`` bound to ``value``. What a lambda refers to would otherwise be merged into it and computed per element."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def size(self, arr: str) -> str:
        return f"cast(size({arr}) as bigint)"

    def sum(self, arr: str, zero: str = "0L") -> str:
        return f"aggregate({arr}, {zero}, (a, b) -> a + b)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def concat_arrays(self, *items: str) -> str:
        return f"concat({', '.join(items)})"

    def flatten(self, arr: str) -> str:
        return f"flatten({arr})"

    def at(self, arr: str, i: str) -> str:
        """Element by a number from 0."""
        return f"get({arr}, cast({i} as int))"

    def slice(self, arr: str, start: str, n: str) -> str:
        """``n`` elements from the one with number ``start`` (from 0)."""
        return f"slice({arr}, cast({start} as int) + 1, greatest(0, cast({n} as int)))"

    def split(self, s: str, regex: str) -> str:
        return f"split({s}, {self.pattern(regex)}, -1)"

    def extract_all(self, s: str, regex: str) -> str:
        return f"regexp_extract_all({s}, {self.pattern(regex)}, 0)"

    def extract(self, s: str, regex: str, group: int) -> str:
        return f"regexp_extract({s}, {self.pattern(regex)}, {group})"

    def replace_all(self, s: str, regex: str, to: str) -> str:
        return f"regexp_replace({s}, {self.pattern(regex)}, {self.lit(to)})"

    def matches(self, s: str, regex: str) -> str:
        return f"({s} rlike {self.pattern(regex)})"

    def contains(self, s: str, word: str) -> str:
        if s in WHOLE:  # bytes are copied and searched in half the time that a string takes
            looks = (f"contains(cast({s} as binary), X'{w.encode().hex()}')" for w in dict.fromkeys((probe(word), word)))
            return f"({' and '.join(looks)})"
        return f"contains({s}, {self.lit(word)})"

    def starts(self, s: str, word: str) -> str:
        return f"startswith({s}, {self.lit(word)})"

    def bytes(self, s: str) -> str:
        return f"octet_length({s})"

    def join(self, arr: str, sep: str) -> str:
        return f"array_join({arr}, {self.lit(sep)})"

    def distinct(self, arr: str) -> str:
        return f"array_distinct({arr})"

    def sorted(self, arr: str) -> str:
        return f"array_sort({arr})"

    def double(self, x: str) -> str:
        return f"cast({x} as double)"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def without(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def range(self, n: str) -> str:
        """0 to n - 1, empty for n = 0."""
        return f"(case when {n} > 0 then sequence(0L, {n} - 1) else cast(array() as array<bigint>) end)"


class Check(Dialect):
    """The checking database's SQL."""

    name = "check"

    def lit(self, s: str) -> str:
        if "\n" in s or "\t" in s:
            parts = s.replace("\t", "\0t\0").replace("\n", "\0n\0").split("\0")
            return "(" + " || ".join({"n": "chr(10)", "t": "chr(9)"}.get(p) if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts)) + ")"
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, regex: str) -> str:
        return self.lit(regex)

    def map(self, arr: str, names: str, body: str) -> str:
        return self._indexed("list_transform", arr, names, body)

    def keep(self, arr: str, names: str, body: str) -> str:
        return self._indexed("list_filter", arr, names, body)

    def _indexed(self, f: str, arr: str, names: str, body: str) -> str:
        if "," in names:
            x, i = (n.strip() for n in names.split(","))
            return f"{f}({arr}, lambda {x}, {i}_: {self._minus(body, i)})"
        return f"{f}({arr}, lambda {names}: {body})"

    @staticmethod
    def _minus(body: str, i: str) -> str:
        import re

        return re.sub(rf"\b{i}\b", f"({i}_ - 1)", body)

    def gate(self, arr: str, test: str) -> str:
        return arr

    def let(self, value: str, name: str, body: str) -> str:
        return f"(list_transform([{value}], lambda {name}: {body}))[1]"

    def any(self, arr: str, name: str, body: str) -> str:
        return f"(len(list_filter({arr}, lambda {name}: {body})) > 0)"

    def size(self, arr: str) -> str:
        return f"CAST(len({arr}) AS BIGINT)"

    def sum(self, arr: str, zero: str = "0L") -> str:
        return f"CAST(coalesce(list_sum({arr}), 0) AS {'BIGINT' if zero == '0L' else 'DOUBLE'})"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def concat_arrays(self, *items: str) -> str:
        out = items[0]
        for x in items[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def at(self, arr: str, i: str) -> str:
        return f"({arr})[CAST({i} AS BIGINT) + 1]"

    def slice(self, arr: str, start: str, n: str) -> str:
        return f"({arr})[CAST({start} AS BIGINT) + 1 : CAST({start} AS BIGINT) + greatest(0, CAST({n} AS BIGINT))]"

    def split(self, s: str, regex: str) -> str:
        return f"string_split_regex({s}, {self.lit(regex)})"

    def extract_all(self, s: str, regex: str) -> str:
        return f"regexp_extract_all({s}, {self.lit(regex)})"

    def replace_all(self, s: str, regex: str, to: str) -> str:
        return f"regexp_replace({s}, {self.lit(regex)}, {self.lit(to)}, 'g')"

    def matches(self, s: str, regex: str) -> str:
        return f"regexp_matches({s}, {self.lit(regex)})"

    def contains(self, s: str, word: str) -> str:
        return f"contains({s}, {self.lit(word)})"

    def starts(self, s: str, word: str) -> str:
        return f"starts_with({s}, {self.lit(word)})"

    def bytes(self, s: str) -> str:
        return f"strlen({s})"

    def join(self, arr: str, sep: str) -> str:
        return f"coalesce(array_to_string({arr}, {self.lit(sep)}), '')"

    def distinct(self, arr: str) -> str:
        return f"list_distinct({arr})"

    def sorted(self, arr: str) -> str:
        return f"list_sort({arr})"

    def common(self, a: str, b: str) -> str:
        return f"list_distinct(list_intersect({a}, {b}))"

    def without(self, a: str, b: str) -> str:
        return self.let(b, "b_", f"list_distinct(list_filter({a}, lambda w_: NOT list_contains(b_, w_)))")

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def range(self, n: str) -> str:
        return f"range(CAST({n} AS BIGINT))"


SPARK, CHECK = Dialect(), Check()
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def layers(steps: Steps) -> list[Steps]:
    """``steps`` in as few layers as their names allow: a step comes after what it reads was made, and makes a name anew no earlier than others have read the old one."""
    made: dict[str, int] = {}  # name to the layer of its last step
    read: dict[str, int] = {}  # name to the last layer that reads it
    out: list[Steps] = []
    for name, expression in steps:
        names = set(_WORD.findall(expression))
        at = max([0, *(made[n] + 1 for n in names if n in made), read.get(name, 0), made.get(name, -1) + 1])
        out += [[] for _ in range(at + 1 - len(out))]
        out[at].append((name, expression))
        made[name] = at
        for n in names:
            read[n] = max(read.get(n, 0), at)
    return out


def apply(df: DataFrame, steps: Steps) -> DataFrame:
    """Add the steps' columns, a layer at a time: Spark checks a plan anew for every projection that is put on it."""
    for layer in layers(steps):
        df = df.withColumns({name: F.expr(expression) for name, expression in layer})
    return df


def ctes(base: str, steps: Steps, last: str = "result") -> str:
    """``base`` is a query; returns the text of a WITH list whose last table is ``last``."""
    out, prior = [f"s0 AS ({base})"], "s0"
    for i, (name, expression) in enumerate(steps, 1):
        out.append(f"s{i} AS (SELECT *, {expression} AS {name} FROM {prior})")
        prior = f"s{i}"
    out.append(f"{last} AS (SELECT * FROM {prior})")
    return ", ".join(out)


def query(base: str, steps: Steps, select: str) -> str:
    return f"WITH {ctes(base, steps)} {select}"


Maker = Callable[[Dialect], Steps]
