"""Spelling variants, the lexicon encoder and hard negatives against brute force, on small inputs with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import lexicon_bpe, negatives, packing, spelling

DOCS = "doc_id long, text string, word string, n long, root string, run string, ids string, h string"


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "w", 1, "r", "run", "i", "h") for i, t in enumerate(texts)], DOCS)


def brute_words(texts, ids):
    seen = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    form = {}
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = [n, len(close), form[w], words[form[w]] if form[w] else None]
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w].append(end)
    return {w: tuple(x) for w, x in out.items()}


def variants_of(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    base = ["alphabet", "garden", "gardens", "straße", "Überzug", "naïveté", "letters", "lettres", "banana", "bananas", "abcde", "abcdf", "abcdex", "çàèéù", "çàèéú"]
    texts = []
    for i in range(150):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice("aeß") + w[at:], w[: max(0, at - 1)] + w[at:], w[: max(0, at - 1)] + rng.choice("xyé") + w[at:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", ", ", "1", "\n"]).join(words))
    return [None, "", " 12 ", "x×y÷z", *texts, texts[0], "garden " * 3000]


def test_spelling(spark, misspelt):
    ids = [None, 1, 1, None, *range(4, len(misspelt))]
    words = brute_words(misspelt, ids)
    assert len(words) > 150
    want = brute_variants(words)
    assert any(x[4] != x[2] and x[2] for x in want.values())  # chains of more than one step
    assert variants_of(spelling.variants(spelling.corpus_words(documents(spark, misspelt, ids)))) == want


def test_spelling_of_any_words(spark):
    """Words of letters beyond the pattern, one letter only, and of hardly differing masks."""
    words = {"a": 9, "aa": 3, "b": 4, "中文": 2, "中": 1, "𝔸𝔹": 5, "𝔸": 1, "aab": 1, "aba": 1, "baa": 1, "z" * 300: 2, "z" * 301: 9}
    assert variants_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_variants(words)
    empty = documents(spark, ["x"]).limit(0)
    assert spelling.variants(spelling.corpus_words(empty)).count() == 0


def test_spelling_chain(spark):
    """A chain of forms longer than a few rounds of doubling."""
    words = {"a" * i + "bcdef": 3 * 2**i for i in range(12)}
    got = variants_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words) and {r[4] for r in got.values()} == {"a" * 11 + "bcdef"}


def raw_ids(ids):
    return np.array(ids, np.uint16).tobytes()


def test_transducer():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9))) + rng.choice([b"ing", b"ed", b""]) for _ in range(3000)})
    made = lexicon_bpe.Transducer.build([(w, raw_ids([i % 7] * (i % 4))) for i, w in enumerate(words)])
    numbers = made.numbers([*words, b"zzz", b"", b"abcdabcdabcdabcd"])
    assert numbers.tolist() == [*range(len(words)), -1, -1, -1]
    assert [len(x) for x in made.ids_of(numbers[:4])] == [0, 2, 4, 6]
    # minimal: no two states have the same way on
    arcs, targets, finals = (made.parts[k] for k in ("arcs", "targets", "finals"))
    ways = [(int(f), tuple((int(a) % 256, int(t)) for a, t in zip(arcs[arcs // 256 == s], targets[arcs // 256 == s], strict=True))) for s, f in enumerate(finals)]
    assert len(set(ways)) == len(ways) < sum(map(len, words)) / 5
    nothing = lexicon_bpe.Transducer.build([])
    assert nothing.numbers([b"a", b""]).tolist() == [-1, -1]


def test_transducer_file(tmp_path):
    made = lexicon_bpe.Transducer.build([(b"ab", raw_ids([1, 2])), (b"abc", raw_ids([3])), (b"b", b"")])
    (tmp_path / "x").write_bytes(made.packed())
    again = lexicon_bpe.Transducer.mapped(str(tmp_path / "x"))
    assert all(again.parts[k].tolist() == made.parts[k].tolist() for k in made.parts)
    assert isinstance(again.parts["arcs"].base, np.memmap) and again.ids_of(np.array([1, 2])) == [raw_ids([3]), b""]


def odd_texts():
    rng = random.Random(11)
    pool = [chr(c) for c in range(1, 0x250) if c != 0x22] + ["́", "α", "中", "😀", " ", "　", "가", "٠", "Ⅰ", "<|endoftext|>"]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("the and  ing 's 'll") for _ in range(rng.randrange(60))) for _ in range(400)]
    return [None, "", " ", "a" * 20_000, "ab" * 9_000 + " end", " " * 5_000 + "x", "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y", "same words", "same words", *texts]


@pytest.mark.parametrize("words", [0, 5, 100_000])
def test_bpe(spark, words):
    """With no lexicon, a tiny one and one of all words: always the library's ids."""
    from tokenizers import Tokenizer

    model, texts = Tokenizer.from_file(packing.tokenizer_path()), odd_texts()
    got = {r["doc_id"]: r for r in lexicon_bpe.decode(lexicon_bpe.encode(documents(spark, texts), words=words)).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, repr(t)
        assert got[i]["text"] == model.decode(ids, skip_special_tokens=False) == (t or "")


def test_bpe_query_and_edges(spark, tmp_path):
    texts = odd_texts()[:40]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in lexicon_bpe.op13_bpe(spark, str(tmp_path)).collect()}
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids
        assert got[i].asDict() == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
    assert lexicon_bpe.encode(documents(spark, ["x"]).limit(0)).count() == 0
    rows = spark.createDataFrame([([220, 50256, 60000], "old"), (None, "old"), ([], "old"), ([94, 94], "old")], "ids array<long>, text string")
    assert [r["text"] for r in lexicon_bpe.decode(rows).collect()] == [" <|endoftext|>", None, "", model.decode([94, 94], skip_special_tokens=False)]


def brute_negatives(data, anchors, most=(1 << 63) - 1):
    def ready(rows):
        out = set()
        for i, label, v in rows:
            if i is not None and label is not None and v and not any(x is None or x != x or abs(float(x) * 256) == float("inf") for x in v):
                out.add((i, label, tuple(int(np.floor(x * 256)) for x in map(float, v))))
        return sorted(out)

    rows, out = ready(data), []
    for a, label, v in ready(anchors):
        met = [(max(-most, min(most, sum(x * y for x, y in zip(v, w, strict=True)))), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        met.sort(key=lambda x: (-x[0], x[1]))
        for p, positive, _ in [x for x in met if x[2] == label][:5]:
            fit = [x for x in met if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a, positive, r + 1, i, p, s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, data, anchors):
    schema = "vec_id long, label int, embedding array<double>"
    extra = lambda rows: spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("v", "row", "band", "a", "pivot", "key", "rank")})
    got = negatives.hard_negatives(extra(data), extra(anchors))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("ring", "block", "spread"), [(1024, 16_384, 1.0), (20, 7, 0.05)])
def test_negatives(spark, monkeypatch, ring, block, spread):
    """One ring, and many small ones of clustered vectors in tiny blocks."""
    monkeypatch.setattr(negatives, "RING_ROWS", ring)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    data = [(i, int(rng.integers(4)) if i % 11 else None, (centres[i % 6] + spread * rng.normal(size=8)).tolist()) for i in range(700)]
    data += [(1000 + i, 1, data[5][2]) for i in range(60)] + [data[6]] * 30 + [(2000, 2, None), (2001, 2, [1.0, None]), (2002, 2, [float("nan")] * 8), (None, 1, [1.0] * 8), (2003, 3, [])]
    data += [(2100, 1, [1.0, 2.0]), (2101, 1, [1.0, 1.0]), (2102, 2, [0.8, 0.6]), (2103, 9, [0.0] * 8)]
    anchors = [r for r in data if r[0] is None or r[0] % 50 == 0 or r[0] in (2101, 5)]
    want = brute_negatives(data, anchors)
    assert len(want) > 100
    assert mined(spark, data, anchors) == want


def test_negatives_of_large_numbers(spark):
    rng = np.random.default_rng(9)
    size = [1.0, 1e3, 1e7, 1e60, 1.34e154, 1e160, 1e300]
    data = [(i, i % 3, (rng.normal(size=8) * size[i % 7 if i % 2 else 0]).tolist()) for i in range(300)]
    anchors = [r for r in data if r[0] % 10 == 0 or r[0] % 7 in (4, 5, 6)][:60]
    assert mined(spark, data, anchors) == brute_negatives(data, anchors)


def test_negatives_empty(spark):
    one = [(0, 1, [1.0, 2.0])]
    assert mined(spark, one, one) == []
    assert negatives.hard_negatives(spark.createDataFrame(one, "vec_id long, label int, embedding array<double>").limit(0), spark.createDataFrame(one, "vec_id long, label int, embedding array<double>")).count() == 0
