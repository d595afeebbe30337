"""Native expressions against scalar models: the largest block, placeholders, JSON, tokens and words."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from promptloom.functions import text as X
from promptloom.functions.dialect import SPARK
from promptloom.operators import parse, score


def balanced(text, start):
    """The end of the balanced {...} that opens at ``start``."""
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text)):
        c = text[at]
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
    return None


def largest_block(text):
    best, at = None, text.find("{")
    while at >= 0:
        end = balanced(text, at)
        if end is None:
            at = text.find("{", at + 1)
            continue
        if best is None or len(text[at:end].encode()) > len(best.encode()):
            best = text[at:end]
        at = text.find("{", end)
    return best


def without_placeholders(block):
    out, at = [], 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|<[^>]*>|\.\.\.', block, re.S):
        out += [block[at : m.start()], m.group() if m.group()[0] == '"' else "null"]
        at = m.end()
    s = "".join([*out, block[at:]])
    for t in parse.TYPE_WORDS:
        s = re.sub(f": {t}(?=[,}} \n])", ": null", s)
    return s


def is_json(block):
    def no_constant(name):
        raise ValueError(name)

    try:
        json.loads(block, parse_constant=no_constant)
    except ValueError:
        return False
    return True



def count_tokens(text):
    total = 0
    for run in re.findall(r"[\t-\r ]{2,}|[A-Za-z][A-Za-z']*|[0-9]+|[^\x00-\x7F]|[^\t-\r A-Za-z0-9\x80-\U0010FFFF]+", text):
        if run[0] in "\t\n\x0b\x0c\r ":
            parts = run.split("\n")
            total += max(1, len(parts) - 1 + sum(len(p) // 4 for p in parts) + (len(parts[-1]) % 4 > 0))
        elif re.match("[A-Za-z]", run):
            n = len(run)
            total += 1 if n <= 7 else 2 if n <= 12 else 3 if n <= 16 else 3 + (n - 13) // 4
        elif run[0].isascii() and run[0].isdigit():
            total += (len(run) + 2) // 3
        else:
            total += (len(run) + 1) // 2 if run[0].isascii() else 1
    return max(total, 1) if text else 0


def answers(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4).selectExpr("i", f"{expression} as x")
    return [r["x"] for r in df.orderBy("i").collect()]


def drawn(parts, n, most, seed):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randrange(most))) for _ in range(n)]


KNOWN = [("x {} y", "{}", True), ('{"a": <n>, "b": [...]}', '{"a": <n>, "b": [...]}', True), ("{ a: 1 }", "{ a: 1 }", False), ('{"}": 1', None, None), ('{ {"a": string} ', '{"a": string}', True), ("{'a': NaN}", "{'a': NaN}", False),
         ('{"a": 1, "a": 2}', '{"a": 1, "a": 2}', True), ('{"a": "\t"}', '{"a": "\t"}', False), ('{"a": NaN}', '{"a": NaN}', False), ('{"a": 01}', '{"a": 01}', False), ('{"a": "\\x"}', '{"a": "\\x"}', False), ('{"_bad": 1}', '{"_bad": 1}', True),
         ('{"a": [1, {"b": [true, null, -1.5e3]}]}', '{"a": [1, {"b": [true, null, -1.5e3]}]}', True), ('{"a": 1,}', '{"a": 1,}', False), ('{"a" 1}', '{"a" 1}', False), ("{{x}} {yz} {é}", "{{x}}", False)]


def test_schema_known(spark):
    texts = [t for t, _, _ in KNOWN]
    assert answers(spark, texts, parse.largest_block("text")) == [b for _, b, _ in KNOWN]
    df = parse.with_schema(spark.createDataFrame(list(enumerate([*texts, "", None])), "i int, text string").withColumn("lc", F.lower("text"))).orderBy("i")
    got = [(r["schema"]["present"], r["schema"]["valid"], r["schema_score"]) for r in df.collect()]
    assert got == [(b is not None, bool(v), 1.0 if v else 0.4 if b else 0.6) for _, b, v in KNOWN] + [(False, False, 0.6)] * 2


def keys_of_first(text):
    """Keys of the block at the first brace, if that closes and is JSON."""
    at = text.find("{")
    end = balanced(text, at) if at >= 0 else None
    return list(dict.fromkeys(json.loads(text[at:end]))) if end and is_json(text[at:end]) else None


def test_keys_against_model(spark):
    texts = drawn(["{", "}", "{}", '{"a": 1}', '"b": {}', '"c": [1, {"d": 2}]', ", ", '"', "x", "\\", '{"a": "}"}'], 4000, 9, 6)
    got = answers(spark, texts, parse.keys(parse.first_block("text")))
    assert [x if x is None else list(dict.fromkeys(x)) for x in got] == [keys_of_first(t) for t in texts]
    assert {str(x) for x in got} >= {"None", "[]", "['a']", "['b']", "['c']"}


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_against_model(spark, seed):
    texts = drawn(["{", "{", "}", "}", '"', "\\", "a", "é", "\U0001F600", " ", "\n"], 3000, 24, seed)
    assert answers(spark, texts, parse.largest_block("text")) == [largest_block(t) for t in texts]


def test_placeholders_and_json_against_model(spark):
    inner = drawn(['"', '"a"', '"b": ', ": string", ": number,", ",", "1", "-2.5", "[", "]", "<x>", "<", ">", "...", ".", "null", "true", '"a": 1', "\\", "\n", " ", "{}", '"c": {"d": []}'], 4000, 9, 3)
    blocks = ["{" + x + "}" for x in inner]
    plain = [without_placeholders(b) for b in blocks]
    assert answers(spark, blocks, parse.without_placeholders("text")) == plain
    assert answers(spark, plain, parse.parses("text")) == [is_json(b) for b in plain]
    assert sum(map(is_json, plain)) > 100


def test_long_block(spark):
    text = "x { " + json.dumps({f"k{i}": {"v": ["<b>", i]} for i in range(3000)}) + ' "'
    got = answers(spark, [text], parse.largest_block("text"))
    assert got == [largest_block(text)] and is_json(got[0])


def test_tokens_and_words_against_model(spark):
    parts = ["a", "Z", "'", "''", "abcdefg", "x" * 11, "y" * 35, "z'z" * 20, " ", "  ", "\n", "\t", "\r\n", "    ", "1", "234", "99999", ".", ",", "!?", "é", "中", "\U0001F600", "\xa0", " ", "\x85", "\x0b", "\x00", "\x7f", "'" * 31]
    texts = ["", " ", "\n\n", "'" * 29 + "a" * 80, "a" + "'" * 28 + "b" * 50, "a" * 36 + "'" + "b" * 3, *(n * "w" for n in range(1, 90)), *drawn(parts, 3000, 14, 4), *drawn(parts[:-1], 3000, 14, 5)]
    assert answers(spark, texts, X.tokens(SPARK, "text")) == [count_tokens(t) for t in texts]
    space = r"\t-\r \x85\xa0  -     　"
    assert answers(spark, texts, X.words(SPARK, "text")) == [len(re.findall(f"[^{space}]+", t)) for t in texts]
    assert answers(spark, ["  ", None], X.tokens(SPARK, "text")) == [1, None]


def test_analysis_stays_in_the_jvm(spark):
    df = score.analyze(spark.createDataFrame([(1, 'Return {"a": <n>}')], "prompt_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and df.first()["schema"]["valid"]
