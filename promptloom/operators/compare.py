"""Drift between an original and a transformed text, line diff, and cosine of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions import scan
from ..functions import text as X
from ..functions.dialect import SPARK, Dialect, Steps, apply
from . import parse

_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)
_ALNUM = r"[0-9A-Za-z\p{IsAlphabetic}\p{N}]+", r"[\p{L}\p{N}]+"


def _alnum(d: Dialect, s: str) -> str:
    return d.extract_all(s, _ALNUM[0] if d.name == "spark" else _ALNUM[1])


def numbers(d: Dialect, s: str) -> str:
    """Number literals, a trailing dot aside."""
    return d.map(d.extract_all(s, "[0-9][0-9.%]*"), "x", "trim(TRAILING '.' FROM x)" if d.name == "spark" else d.replace_all("x", "[.]+$", ""))


def entities(d: Dialect, s: str) -> str:
    """Words of two bytes or more that begin with A-Z and are no stop words."""
    if d.name == "spark":  # words that don't begin so aren't taken at all
        capital = d.extract_all(s, f"[A-Z](?<!{_ALNUM[0][:-1]}.){_ALNUM[0]}+")
        # a look behind takes characters beyond the first plane for two: there one scan over all words, of which the others leave nothing
        scan_ = f"array_remove(regexp_extract_all({s}, {d.pattern(f'([A-Z]{_ALNUM[0]}+)|{_ALNUM[0]}+')}, 1), '')"
        wide = f"octet_length({s}) <> length({s}) and {d.matches(s, '[\\x{10000}-\\x{10FFFF}]')}"
        return d.keep(f"if({wide}, {scan_}, {capital})", "x", f"{X.lower(d, 'x')} not in ({_STOP})")
    return d.keep(_alnum(d, s), "x", f"{d.bytes('x')} >= 2 and {d.matches('x', '^[A-Z]')} and {X.lower(d, 'x')} not in ({_STOP})")


def content_words(d: Dialect, s: str, once: bool = False) -> str:
    """Words of three bytes or more, in lower case, that are no stop words. ``once``: the engine drops repeats before it looks at them."""
    lowered = _alnum(d, X.lower(d, s)) if d.name == "spark" else d.map(_alnum(d, s), "x", X.lower(d, "x"))
    return d.keep(d.distinct(lowered) if once and d.name == "spark" else lowered, "x", f"{d.bytes('x')} > 2 and x not in ({_STOP})")


def drift(d: Dialect, original: str = "text", transformed: str = "transformed") -> Steps:
    """Reads ``constraints`` of the original. Retentions are 1 where there is nothing to retain."""
    one = "cast(1 as double)"

    def kept(of, name: str) -> tuple[str, str]:
        mine = d.distinct(of(d, original))
        lost = d.sorted(d.without(name if d.name == "spark" else of(d, original), of(d, transformed)))
        return mine, lost

    num, lost_num = kept(numbers, "_num")
    ent, lost_ent = kept(entities, "_ent")
    rate = lambda all_, lost: f"case when {d.size(all_)} = 0 then {one} else ({one} * {d.size(all_)} - {d.size(lost)}) / {d.size(all_)} end"
    low = X.lower(d, transformed)
    keys = d.keep(content_words(d, "c.text"), "w", f"{d.bytes('w')} > 3")
    hits = d.keep("c.w", "w", "contains(lo, w)")
    survive = d.let("_low", "lo", d.keep("_keys", "c", f"{d.size('c.w')} = 0 or {d.size(hits)} * 2 >= {d.size('c.w')}"))
    a, b = d.distinct(content_words(d, original, True)), d.distinct(content_words(d, transformed, True))
    return [
        ("_low", low), ("_num", num), ("lost_numbers", lost_num), ("_ent", ent), ("lost_entities", lost_ent),
        ("number_retention", rate("_num", "lost_numbers")), ("entity_retention", rate("_ent", "lost_entities")),
        ("_keys", d.map("constraints", "c", d.struct(w=keys))),
        ("constraint_retention", f"case when n_constraints = 0 then {one} else {one} * {d.size(survive)} / n_constraints end"),
        ("_a", a), ("_b", b), ("_both", d.common("_a", "_b")),
        ("lexical_similarity", f"case when {d.size('_a')} = 0 and {d.size('_b')} = 0 then {one} else {one} * {d.size('_both')} / ({d.size('_a')} + {d.size('_b')} - {d.size('_both')}) end"),
        ("drift", X.clamp(f"({one} - ({X.num(0.45)} * number_retention + {X.num(0.35)} * constraint_retention + {X.num(0.2)} * entity_retention))")),
        ("within_tolerance", f"(number_retention >= {X.num(0.999)} and constraint_retention >= {X.num(0.9)})"),
    ]


def with_drift(df: DataFrame, original: str = "text", transformed: str = "transformed") -> DataFrame:
    """Add the drift columns. ``constraints`` are extracted from the original if they aren't there."""
    if "constraints" not in df.columns:
        df = apply(df, [("lines", X.lines(SPARK, original)), ("_lc", X.lower(SPARK, original)), *parse.constraints(SPARK, "_lc")]).drop("lines")
    df = apply(df, drift(SPARK, original, transformed))
    return df.drop(*(c for c in df.columns if c.startswith("_")))


OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))
DIFF = T.StructType([T.StructField("ops", OPS), T.StructField("markdown", T.StringType())])
#: Bytes of text whose scripts are held at once: lines as objects take many times their size.
DIFF_CHUNK = 1 << 18
_SIGNS = {"ins": "+ ", "del": "- ", "eq": "  "}


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def _rows(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table of common lengths of what is left of both, upwards from the row ``last`` below ``a``: equal lines take the diagonal, a running maximum along the row does the rest."""
    for line in a[::-1]:
        row = np.empty_like(last)
        row[-1] = 0
        row[:-1] = np.where(b == line, last[1:] + 1, last[:-1])
        last = np.maximum.accumulate(row[::-1])[::-1]
        yield last


def diff_lines(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """An edit script along a longest common subsequence; of equal choices the deletion comes first.

    What both begin with is cut off; not what they end with, as that would match other lines of those that repeat. Of
    the table of n by m only every sqrt(n)th row is kept; the rows between two of them are made again on the way down.
    """
    head = next((i for i, (x, y) in enumerate(zip(old, new, strict=False)) if x != y), min(len(old), len(new)))
    out = [("eq", s) for s in old[:head]]
    old, new = old[head:], new[head:]
    n, m = len(old), len(new)
    ids = {s: i for i, s in enumerate(dict.fromkeys([*old, *new]))}
    a, b = np.array([ids[s] for s in old], np.int32), np.array([ids[s] for s in new], np.int32)
    step = isqrt(n) + 1
    kept = {n: np.zeros(m + 1, np.int32)}
    for i, row in enumerate(_rows(a, b, kept[n])):
        if (n - 1 - i) % step == 0:
            kept[n - 1 - i] = row
    i = j = 0
    for top in range(0, n, step):
        end = min(top + step, n)
        if j == m:
            break
        table = [kept[end][j:], *_rows(a[top:end], b[j:], kept.pop(end)[j:])][::-1]  # of the columns from j on
        left = j
        while i < end and j < m:
            if a[i] == b[j]:
                out.append(("eq", old[i]))
                i, j = i + 1, j + 1
            elif table[i + 1 - top][j - left] >= table[i - top][j + 1 - left]:
                out.append(("del", old[i]))
                i += 1
            else:
                out.append(("ins", new[j]))
                j += 1
    return out + [("del", s) for s in old[i:]] + [("ins", s) for s in new[j:]]


def markdown(ops: list[tuple[str, str]]) -> str:
    """The script as a fenced block."""
    return "".join(["```diff\n", *(f"{_SIGNS[o]}{t}\n" for o, t in ops), "```\n"])


@F.arrow_udf(DIFF)
def line_diff(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``ops`` and ``markdown`` for each pair of texts; nulls where a text is null. A worker holds the scripts of about DIFF_CHUNK bytes of text at a time."""
    for batch in pairs:
        for old, new in scan.chunks(*batch, size=DIFF_CHUNK):
            found = [None if a is None or b is None else diff_lines(_lines(a), _lines(b)) for a, b in zip(old.to_pylist(), new.to_pylist(), strict=True)]
            missing = np.array([f is None for f in found])
            ends = np.cumsum([0, *(len(f or ()) for f in found)])
            flat = [op for f in found if f for op in f]
            items = pa.StructArray.from_arrays([pa.array([o for o, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())], names=["op", "text"])
            ops = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(missing))
            yield pa.StructArray.from_arrays([ops, pa.array([None if f is None else markdown(f) for f in found], pa.string())], names=["ops", "markdown"])


def cosine(a: str, b: str) -> str:
    """Dot product of normalised vectors, over the shorter length."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(cast(x as double) * cast(y as double), 0D)), 0D, (s, x) -> s + x)"


def semantic_drift(a: str, b: str):
    """(similarity, drift, available) of two embeddings; without them similarity 1 and drift 0."""
    have = f"({a} is not null and {b} is not null)"
    near = f"case when {have} then {X.clamp(cosine(a, b))} else 1D end"
    return F.expr(f"named_struct('similarity', {near}, 'drift', 1D - {near}, 'available', {have})")
