"""Forms that the engine gets through faster mean what the plain ones mean, and what a gate rules out isn't worked out."""

import random

import pytest
from pyspark.sql import functions as F

from promptloom.functions import lexicon as L
from promptloom.functions import text as X
from promptloom.functions.dialect import SPARK, apply, probe, spelled
from promptloom.operators import compare, firewall, parse

CLASSES = (
    f"[{X.WS}]", f"[^{firewall.BREAKS}]", f"^[-*•0-9.){X.WS}]", r"[^\t-\r A-Za-z0-9\x80-\x{10FFFF}]", "[*_`]", '[{}"]', "[^:]", r"[^\x00-\x7F]", r"[\p{IsAlphabetic}\p{N}]", "[]a]", r"[\]\-x]", "[^.]", "(?i)[a-c]", "[a-z&&[^b]]",
)


def test_classes_are_spelled_without_ranges():
    assert spelled("[a-c]+x[.]") == r"[abc]+x[\x2E]" and spelled(r"\[a-c]") == r"\[a-c]" and spelled("[a-z&&[^b]]") == "[a-z&&[^b]]"
    assert "-" not in spelled(f"[^{firewall.BREAKS}]").split("[", 2)[1]


@pytest.mark.parametrize("regex", CLASSES)
def test_spelled_classes_match_the_same_characters(spark, regex):
    codes = [c for c in (*range(0x3100), 0xFF21, 0x1F600, 0x10FFFF) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c),) for c in codes], "c string")
    assert df.where(F.expr(f"c rlike {SPARK.lit(regex)}") != F.expr(f"c rlike {SPARK.lit(spelled(regex))}")).count() == 0


def test_entities_and_lower_case_against_models(spark):
    r = random.Random(3)
    parts = ["A", "Ab", "É", "é", "ß", "1", " ", "-", "The", "the", "İ", "Σ", "\U00010400", "Z9", "x", "½", "́"]
    texts = ["", *("".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000))]
    plain = f"filter(regexp_extract_all(text, '[\\\\p{{IsAlphabetic}}\\\\p{{N}}]+', 0), x -> octet_length(x) >= 2 and x rlike '^[A-Z]' and translate(x, '{X.UPPER}', '{X.LOWER}') not in ({', '.join(repr(w) for w in L.STOPWORDS)}))"
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"{compare.entities(SPARK, 'text')} as a", f"{plain} as b", f"{X.lower(SPARK, 'text')} as low", f"translate(text, '{X.UPPER}', '{X.LOWER}') as plain")
    assert all(x.a == x.b and x.low == x.plain for x in df.collect())


def test_words_are_looked_for_in_the_bytes_of_a_text(spark):
    assert [probe(w) for w in ("example", "json", "table", "as a chatbot", "to", "{", "eat")] == ["xample", "json", "ble", "bot", "to", "{", "eat"]
    assert "cast(lc as binary)" in SPARK.contains("lc", "table") and "translate" not in X.lower(SPARK, "text")
    r = random.Random(5)
    words = ("example", "table", "as a chatbot", "étape", "e", "{", "naïve x")
    texts = [None, "", *("".join(r.choice((*words, "exampl", "xample", "bot", " ", "é", "\u4e00")) for _ in range(r.randrange(6))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "lc string").coalesce(1)
    found = df.selectExpr("lc", *(f"{SPARK.contains('lc', w)} as c{i}" for i, w in enumerate(words)), f"{X.present(SPARK, words)} as p").collect()
    for row in found:
        assert list(row)[1:-1] == [None if row.lc is None else w in row.lc for w in words]
        assert row.p == [w for w in words if w in (row.lc or "")]


def test_long_texts_are_trimmed_like_short_ones(spark):
    blanks = [chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [None, "", "a", *(t for b in blanks for t in (b, b + "a", "a" + b, b + "a b" + b + b, "a" + b + "b"))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    rows = df.selectExpr(f"{X.trim(SPARK, 'text')} as a", f"{X.trim(SPARK, 'text', long=True)} as b", f"{X.trim(SPARK, 'concat(text, text)', long=True)} as c", f"{X.trim(SPARK, 'concat(text, text)')} as d", f"{X.trim_end(SPARK, 'text')} as e", "text").collect()
    blank = "".join(set(blanks) - {"\u200b", "\ufeff"})
    assert all(r.a == r.b and r.c == r.d and r.e == (r.text and r.text.rstrip(blank)) for r in rows)


def test_secrets_are_looked_for_only_where_a_shape_occurs(spark):
    texts = ["sk-12345678", "x SK_test_1", "a=ghp_12345", "AKIA1234", "asia1234", "ASIA1234", "the Canary12", "eyJhb.cde", "AIza12345", "xoxp-1234", "nothing here", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).withColumn("lc", F.expr(X.lower(SPARK, "text")))
    got = [r.secrets and [s.kind for s in r.secrets] for r in apply(df, firewall.secrets(SPARK)).collect()]
    assert got == [["openai-style key"], ["openai-style key"], ["github token"], ["aws access key id"], [], ["aws access key id"], ["seeded canary"], ["jwt"], ["google api key"], ["slack token"], [], [], None]


def test_clauses_come_from_lines_with_a_word_of_the_list(spark):
    text = "plain line; nothing\r\n- You MUST cite; no rule here. never guess\nÉtat: Always Ä\n\nreturn"
    df = spark.createDataFrame([(text,), ("none of them",), ("",), (None,)], "text string").coalesce(1).withColumn("lc", F.expr(X.lower(SPARK, "text")))
    got = [r.constraints and [(c.polarity, c.text, c.line) for c in r.constraints] for r in apply(df, [*parse.lines(SPARK), *parse.constraints(SPARK)]).collect()]
    assert got == [[("must", "You MUST cite", 1), ("must_not", "never guess", 1), ("must", "État: Always Ä", 2)], [], [], None]


def test_embedding_of_a_piece_without_words():
    import pyarrow as pa

    from promptloom.operators import memory

    (piece,) = memory.hash_embed.func(iter([pa.array(["", None, "?! -"])]))
    assert [r and any(r) for r in piece.to_pylist()] == [False, None, False]
