"""Packing along a space-filling curve: neighbours in content share sequences."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
END_ID = 1
#: Dimensions and bits of each on the curve; the projection's seed; how likely two tokens of a text are the same, roughly.
DIMS, BITS, SEED, REPEATS = 4, 10, 20_240_229, 0.01
#: Words whose ids a worker keeps, and their longest: longer ones hardly come again.
KNOWN_WORDS, KNOWN_LENGTH = 400_000, 14
#: Unknown words that are encoded at once.
NEW_WORDS = 2000
#: Letters, numbers and white space below U+0250, as the byte-level tokenizer splits words.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_SPLIT = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_HIGH = re.compile("[^\0-ɏ]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as uint16. The tokenizer never looks across the words that its
    own splitting gives, so each distinct word is encoded once and its ids kept; texts
    with characters from U+0250 on, whose splitting needs full Unicode tables, and texts
    with the string of an added token go to it whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.known = _Known()

    def _ids(self, word: str) -> bytes:
        return array("H", self.model.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words. A blank and letters end where the next blank begins, so such words are encoded as one text."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        made = {}
        if plain:
            got = self.model.encode("".join(plain), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.array(got.word_ids), prepend=-1))
            if len(cuts) == len(plain):
                raw, ends = array("H", got.ids).tobytes(), [*(2 * cuts[1:]).tolist(), 2 * len(got.ids)]
                made = {w: raw[i:j] for w, i, j in zip(plain, (2 * cuts).tolist(), ends, strict=True)}
        made |= {w: self._ids(w) for w in words if w not in made}
        for w, ids in made.items():
            if len(w) <= KNOWN_LENGTH and len(self.known) < KNOWN_WORDS:  # first come: frequent words come early
                self.known[w] = ids
        return made

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Words that aren't known are noted, and encoded together whenever there are NEW_WORDS of them."""
        out: list = []
        waiting: list[tuple[int, list, list[str]]] = []  # number of a text, ids of its words (None: not known), its words that aren't known
        noted = 0

        def fill() -> None:
            made = self._learn(list(dict.fromkeys(w for _, _, words in waiting for w in words)))
            for at, ids, words in waiting:
                i = -1
                for w in words:
                    i = ids.index(None, i + 1)
                    ids[i] = made[w]
                out[at] = b"".join(ids)
            waiting.clear()

        for text in texts:
            if _HIGH.search(text) or any(a in text for a in self.added):
                out.append(self._ids(text))
                continue
            self.known.new = new = []
            ids = list(map(self.known.__getitem__, _SPLIT.findall(text)))
            if not new:
                out.append(b"".join(ids))
                continue
            waiting.append((len(out), ids, new))
            out.append(None)
            noted += len(new)
            if noted >= NEW_WORDS:
                fill()
                noted = 0
        fill()
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


class _Known(dict):
    """Ids of words; one that isn't there is noted in ``new`` and gives None."""

    new: list[str]

    def __missing__(self, word: str) -> None:
        self.new.append(word)


@cache
def _encoder(path: str) -> Encoder:
    """One per worker process: the words that a task has met serve the next ones."""
    return Encoder(path)


@cache
def _directions() -> np.ndarray:
    """A hashed vector component per token id, projected: a sign per id and dimension. The dimensions' plus signs are 0 or 1 in 16 bits each of a number, so that one sum counts them all."""
    plus = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (1 << 16, DIMS)) > 0
    return (plus.astype(np.int64) << 16 * np.arange(DIMS)[::-1]).sum(1)


def _sums(ids: np.ndarray) -> np.ndarray:
    """The sum of the signs of the ids, by dimension; so many ids at once that no count takes more than 15 bits."""
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(ids), 1 << 14):
        part = ids[at : at + (1 << 14)]
        total += 2 * (int(_directions()[part].sum()) >> 16 * np.arange(DIMS)[::-1] & 0xFFFF) - len(part)
    return total


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The index along the Hilbert curve of each row of grid points (Skilling's transform, all rows at once)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        p = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b & 1).astype(bool)
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """The Hilbert keys of documents: their hashed token counts, scaled to about unit length, projected
    and squashed onto the grid. A text's count vector has the squared length n + REPEATS * n * n, roughly."""
    sizes = np.array([len(ids) for ids in docs], np.float64)
    z = np.array([_sums(ids) for ids in docs], np.float64).reshape(-1, DIMS)
    z /= np.sqrt(np.maximum(1, sizes + REPEATS * sizes * sizes))[:, None]
    return hilbert(np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.7 * z))), BITS)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = encode.many([t or "" for t in part.column(1).to_pylist()])
                keys = curve_keys([np.frombuffer(r, "<u2") for r in raw])
                sizes = pa.array([len(r) // 2 + 1 for r in raw], pa.int64())
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(keys, pa.int64()), sizes, pa.array([r + end for r in raw], pa.binary())], names=["doc_id", "tie", "window", "key", "n", "ids"])

    return run


def sizes_of_rest(rest: int) -> list[int]:
    """Lengths of the last sequences of a part: the powers of two that make up ``rest``; they need no padding."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in order: sequences of 2048 tokens, then what is left, cut at powers of two."""
    base, seq, fill, waiting = 0, 0, 0, []  # waiting: (doc, start, ids, doc_tokens) of the sequence that isn't full

    def close(pieces: list[tuple]) -> list[tuple]:
        nonlocal seq
        out, offset = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + seq, offset))
            offset += len(ids)
        seq += 1
        return out

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        found: list[tuple] = []
        for doc, raw, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            base, start = part << 32, 0
            ids = np.frombuffer(raw, "<u2").astype("<u4")
            while start < len(ids):
                n = min(SEQUENCE - fill, len(ids) - start)
                waiting.append((doc, start, ids[start : start + n], len(ids)))
                start, fill = start + n, fill + n
                if fill == SEQUENCE:
                    found += close(waiting)
                    waiting, fill = [], 0
        if found:
            yield rows(found)
    found = []
    for room in sizes_of_rest(fill):
        taken = []
        while room:
            doc, start, ids, total = waiting.pop(0)
            taken.append((doc, start, ids[:room], total))
            if len(ids) > room:
                waiting.insert(0, (doc, start + room, ids[room:], total))
            room -= len(taken[-1][2])
        found += close(taken)
    if found:
        yield rows(found)


def pack(docs: DataFrame, path: str | None = None, part_tokens: int = 4_000_000, window: Column | None = None) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens.

    A document's tokens are its whole text's ids, as the tokenizer gives them
    without options, and then id 1. Documents are ordered along a Hilbert curve
    through a projection of their hashed token counts; the order is cut into
    parts of about ``part_tokens``, and each part's stream at every 2048
    tokens. What a part has left is cut at powers of two, so no sequence needs
    padding. With ``window`` (a number per row) the curve is followed within
    each window, and the windows follow each other in the order of
    sequence_id: so the order of a mix holds on the scale of a window.

    Null texts count as empty: one piece, of id 1. Null or repeated doc_ids
    are documents like any other; documents with equal keys follow in the
    order of a hash of their row, so a large group of copies is split over
    parts; other columns are ignored; an empty table gives no rows. Returns one
    row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A sequence_id is the number of its part times 2**32 and then its
    number there.
    """
    path = path or tokenizer_path()
    tie = F.xxhash64("doc_id", F.monotonically_increasing_id())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"), F.coalesce(F.lit(0) if window is None else window, F.lit(0)).cast("long").alias("window"))
    rows = common.staged(texts.mapInArrow(_encode(path), "doc_id long, tie long, window long, key long, n long, ids binary"), "tokens")
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // part_tokens))
    order = ["window", "key", "tie"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(_pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
