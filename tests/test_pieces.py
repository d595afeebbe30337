"""Work per row that must not grow with the batch or be done for nothing."""

import pyarrow as pa

from promptloom.operators import compare


def test_diff_holds_a_piece_at_a_time():
    old = pa.array(["a\nb\n" * 20_000, None, "x", "", *(f"line {i}\nsame" for i in range(20_000))])
    new = pa.array(["a\nb\n" * 20_000, "y", "x\nz", "", *(f"line {i + i % 2}\nsame" for i in range(20_000))])
    pieces = list(compare.line_diff.func(iter([(old, new)])))
    assert len(pieces) > 2 and max(map(len, pieces)) < 10_000
    rows = [r for p in pieces for r in p.to_pylist()]
    assert rows[1] == {"ops": None, "markdown": None} and rows[3] == {"ops": [], "markdown": "```diff\n```\n"}
    for a, b, r in zip(old.to_pylist(), new.to_pylist(), rows, strict=True):
        if a is not None:
            expected = compare.diff_lines(compare._lines(a), compare._lines(b))
            assert [(o["op"], o["text"]) for o in r["ops"]] == expected and r["markdown"] == compare.markdown(expected)


def test_embedding_holds_a_piece_at_a_time():
    from promptloom.operators import memory

    texts = ["Some words, some words", None, "", *(f"word{i} word{i % 7}" for i in range(3000)), "long " * 500_000]
    pieces = list(memory.hash_embed.func(iter([pa.array(texts)])))
    assert len(pieces) > 2 and max(map(len, pieces)) <= 500
    rows = [r for p in pieces for r in p.to_pylist()]
    assert len(rows) == len(texts) and rows[1] is None and not any(rows[2])
    assert all(abs(sum(x * x for x in r) - 1) < 1e-9 for r in rows[3:] if r)


def test_gate_keeps_what_is_behind_it_from_being_worked_out(spark):
    from promptloom.functions.dialect import SPARK

    costly = "transform(array(id), x -> named_struct('n', if(x > 1, x, cast(raise_error('worked out') as bigint))))"
    rows = spark.range(1, 4).selectExpr(f"{SPARK.gate(costly, 'nullif(id, 3) > 1')} as a").collect()
    assert [r.a and [x.n for x in r.a] for r in rows] == [[], [2], None]


def test_batch_token_counts_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from promptloom.functions import scan
    from promptloom.functions import text as X
    from promptloom.functions.dialect import SPARK

    texts = ["", None, " ", "  ", "\n\n", "a'b ''c' 'd", "x" * 40, "12345 é漢\U0001F600 ?!.", "a  \n     \n  b\t \r\n", "'" * 5, "é'a", "\x00-"]
    df = spark.createDataFrame([(t,) for t in texts * 40], "text string").coalesce(1)
    rows = df.select(scan.token_count("text").alias("n"), F.expr(X.tokens(SPARK, "text")).alias("m")).collect()
    assert [r.n for r in rows] == [r.m for r in rows] and rows[1].n is None and rows[0].n == 0
