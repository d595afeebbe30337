"""Byte-level BPE with a lexicon: frequent words and their ids in a minimal acyclic transducer that workers map
into memory; all other words are merged exactly."""

from __future__ import annotations

import heapq
import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing

#: Words in the lexicon, their longest in bytes (longer ones hardly come again), and distinct words that a task counts before it passes them on.
LEXICON_WORDS, LEXICON_BYTES, COUNTED_WORDS = 100_000, 40, 100_000
#: Documents of one step of the encoder, characters after which a step ends, and widths of the matrices in which words merge; longer ones have a heap each.
STEP_ROWS, STEP_CHARS, SHORT_WORDS = 500, 1_000_000, (8, 16, 32, 64)
NEVER = 1 << 40
_PARTS = ("arcs", "targets", "skips", "finals", "starts", "ids")
_TYPES = {"arcs": np.int64, "targets": np.int32, "skips": np.int32, "finals": np.uint8, "starts": np.int64, "ids": np.uint16}


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it prints, else from U+0100 on."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: ids of byte strings, the rank and result of each merge, and the added tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        model = data["model"]
        self.bytes_of = {i: _raw(t, back) for t, i in model["vocab"].items()}
        self.bytes_of |= {t["id"]: _raw(t["content"], back) for t in data["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.byte_ids = np.array([model["vocab"][c] for _, c in sorted(byte_alphabet().items())], np.int64)
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        if max(self.bytes_of) >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        keys = sorted((a << 16 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pairs, self.pair_ranks = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        self.merged = np.zeros(len(model["merges"]), np.int64)
        for rank, new in self.merges.values():
            self.merged[rank] = new

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids, as uint16, of words on their own: of all neighbouring pairs the one of least rank merges first, the leftmost of equal ones.

        Short words merge together, a merge of each at a time, in a matrix of ids and one of the pairs' ranks.
        """
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in pairwise((0, *SHORT_WORDS)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            ids = self._merge_short([words[i] for i in at.tolist()], sizes[at], high) if len(at) else []
            for i, raw in zip(at.tolist(), ids, strict=True):
                out[i] = raw
        for i in np.flatnonzero(sizes > SHORT_WORDS[-1]).tolist():
            out[i] = np.array(self._merge_long(self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist()), np.uint16).tobytes()
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; NEVER where it doesn't merge or one is missing."""
        key = np.where((a >= 0) & (b >= 0), a * (1 << 16) + b, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def _merge_short(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        left, cols, done = np.arange(len(words)), np.arange(width), np.zeros((len(words), width), np.int64)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(1)
            rank = ranks[np.arange(len(left)), at]
            over = rank == NEVER
            if over.any():
                done[left[over]] = ids[over, :-1]
                left, ids, ranks, at, rank = (x[~over] for x in (left, ids, ranks, at, rank))
            if not len(left):
                break
            rows = np.arange(len(left))
            ids[rows, at] = self.merged[rank]
            after = cols + (cols > at[:, None])  # what lies behind the pair's second id moves up
            ids[:, :-1] = np.take_along_axis(ids, after, 1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(after, width - 1), 1)
            ranks[rows, at] = self._ranks(ids[rows, at], ids[rows, at + 1])
            some = rows[at > 0]
            ranks[some, at[some] - 1] = self._ranks(ids[some, at[some] - 1], ids[some, at[some]])
        there = done >= 0
        ends = np.cumsum(there.sum(1)) * 2
        raw = done[there].astype(np.uint16).tobytes()
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """A long word, with a heap of pairs and links between what is left: n bytes take n log n steps."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if m := self.merges.get((new, ids[j])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            k = before[i]
            if k >= 0 and (m := self.merges.get((ids[k], new))):
                heapq.heappush(heap, (m[0], k, m[1]))
        return [i for i in ids if i >= 0]


def _raw(token: str, back: dict[str, int]) -> bytes:
    return bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Transducer:
    """A minimal acyclic automaton over sorted words. The skips on a word's way add up to its number among the words, which points at its ids.

    The parts are flat arrays: the arcs as state * 256 + byte in order, each arc's target and skip, whether a state ends a word, and the ids by number.
    """

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts

    @classmethod
    def build(cls, words: list[tuple[bytes, bytes]]) -> Transducer:
        """From (word, its ids as uint16) in order of the words, distinct: states whose way on is the same become one as soon as the next word shows that they are complete."""
        register: dict[tuple, int] = {}
        count: list[int] = []  # words below each state
        frozen: list[tuple] = []  # (final, ((byte, state), ...)) of each state

        def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
                count.append(final + sum(count[s] for _, s in arcs))
            return register[key]

        path: list[list] = [[False, []]]  # open states along the last word: final, arcs that are complete
        last = b""
        for word, _ in words:
            common_part = len(os.path.commonprefix([word, last]))
            for depth in range(len(last), common_part, -1):
                path[depth - 1][1].append((last[depth - 1], freeze(*path.pop())))
            path += [[False, []] for _ in range(len(word) - common_part)]
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(*path.pop())))
        root = freeze(*path[0])
        # the root is state 0 in the arrays: numbers count down from it
        arcs, targets, skips = [], [], []
        for state in range(root, -1, -1):
            final, out = frozen[state]
            skip = int(final)
            for byte, to in out:
                arcs.append((root - state) * 256 + byte)
                targets.append(root - to)
                skips.append(skip)
                skip += count[to]
        sizes = [len(ids) // 2 for _, ids in words]
        made = {"arcs": arcs, "targets": targets, "skips": skips, "finals": [frozen[s][0] for s in range(root, -1, -1)], "starts": np.r_[0, np.cumsum(sizes)], "ids": np.frombuffer(b"".join(ids for _, ids in words), np.uint16)}
        return cls({k: np.array(made[k], _TYPES[k]) for k in _PARTS})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 where it isn't in the lexicon: all words take their next byte at once."""
        p = self.parts
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        at = np.r_[0, np.cumsum(sizes)[:-1]] if len(words) else sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes)
        depth = 0
        while len(live) and len(p["arcs"]):
            key = state[live] * 256 + text[at[live] + depth]
            arc = np.minimum(np.searchsorted(p["arcs"], key), len(p["arcs"]) - 1)
            found = p["arcs"][arc] == key
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            state[live] = p["targets"][arc]
            number[live] += p["skips"][arc]
            depth += 1
            live = live[sizes[live] > depth]
        state[live] = -1
        return np.where((state >= 0) & (p["finals"][state] > 0), number, -1)

    def ids_of(self, numbers: np.ndarray) -> list[bytes]:
        raw, starts = self.parts["ids"].view(np.uint8).data, self.parts["starts"]
        return [bytes(raw[a:b]) for a, b in zip((starts[numbers] * 2).tolist(), (starts[numbers + 1] * 2).tolist(), strict=True)]

    def packed(self) -> bytes:
        """A head with the parts' places, then the parts one after another."""
        at, head = 0, {}
        for k in _PARTS:
            head[k] = (at, len(self.parts[k]))
            at += -(-self.parts[k].nbytes // 8) * 8
        raw = json.dumps(head).encode()
        raw += b" " * (-len(raw) % 8)
        body = b"".join(self.parts[k].tobytes() + b"\0" * (-self.parts[k].nbytes % 8) for k in _PARTS)
        return len(raw).to_bytes(8, "little") + raw + body

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The file as it lies on disk: workers of a machine share its pages."""
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        return cls({k: np.memmap(path, _TYPES[k], "r", 8 + size + at, (n,)).view(np.ndarray) if n else np.zeros(0, _TYPES[k]) for k, (at, n) in head.items()})


@cache
def _lexicon(path: str) -> Transducer:
    return Transducer.mapped(path)


class Splitter:
    """The tokenizer's own words of a text, in order; together they are the text. Texts with characters from U+0250 on, whose classes need
    full Unicode tables, are split by the tokenizer's library, others by a pattern of the same classes. Added tokens stand alone."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        added = sorted(_vocabulary(path).added, key=len, reverse=True)
        self.added = set(added)
        self.cut = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __call__(self, text: str) -> list[str]:
        if self.cut and any(a in text for a in self.added):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [*self._plain(text[at : m.start()]), m.group()]
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if packing._HIGH.search(text):
            return [text[a:b] for _, (a, b) in self.split(text)]
        return packing._SPLIT.findall(text)


@cache
def _splitter(path: str) -> Splitter:
    return Splitter(path)


def _counts(path: str):
    """Words and their counts, added up within the task as far as memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(path), Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
                if len(seen) > COUNTED_WORDS:
                    yield from _given(seen)
                    seen.clear()
        yield from _given(seen)

    return run


def _given(seen: Counter) -> Iterator[pa.RecordBatch]:
    words = [w for w in seen if len(w) <= LEXICON_BYTES]
    yield pa.record_batch([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the most frequent words of all texts, at most ``words``, none longer than LEXICON_BYTES.

    The counts are written once. A histogram of them, of eight classes to each power of two, gives the
    least count up from which the words fit; words of one class come or go together.
    """
    counts = docs.select("text").where("text is not null").mapInArrow(_counts(path), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where((F.octet_length("word") <= LEXICON_BYTES) & (F.col("n") > 1))
    counts = common.staged(counts.withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "counts")
    least, room = None, words
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["class"]
    return counts.where(F.lit(False) if least is None else F.col("class") >= least).select("word", "n")


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs`` and put the file into the shared folder; returns its path there.

    The driver holds ``words`` words at most. One word in the lexicon or not makes no difference to any id.
    """
    vocabulary = _vocabulary(path)
    chosen = sorted(r["word"].encode() for r in frequent_words(docs, path, words).select("word").collect() if r["word"] not in vocabulary.added)
    made = Transducer.build(list(zip(chosen, vocabulary.merge(chosen), strict=True)))
    target = common.scratch_path(docs.sparkSession, "lexicon") + ".fst"
    _write(docs.sparkSession, target, made.packed())
    return target


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


class Encoder:
    """Ids of texts: the distinct words of a step walk the transducer together, words that it lacks are merged."""

    def __init__(self, path: str, lexicon: str) -> None:
        self.split, self.vocabulary, self.lexicon = _splitter(path), _vocabulary(path), _lexicon(lexicon)

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        raw = [w.encode() for w in words]
        numbers = self.lexicon.numbers(raw)
        there = np.flatnonzero(numbers >= 0)
        known = dict(zip([words[i] for i in there.tolist()], self.lexicon.ids_of(numbers[there]), strict=True))
        new = np.flatnonzero(numbers < 0).tolist()
        known |= zip([words[i] for i in new], self.vocabulary.merge([raw[i] for i in new]), strict=True)
        known |= {w: np.array([i], np.uint16).tobytes() for w, i in self.vocabulary.added.items()}
        return [b"".join(map(known.__getitem__, s)) for s in split]


def _steps(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a few rows at a time."""
    at, part, chars = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.as_py() or "")
        chars += len(part[-1])
        if len(part) == STEP_ROWS or chars > STEP_CHARS or i == len(texts) - 1:
            yield at, part
            at, part, chars = i + 1, [], 0


def _encoded(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, SparkFiles.get(name))
        for batch in batches:
            for at, texts in _steps(batch.column(1)):
                raw = encode(texts)
                ids = np.frombuffer(b"".join(raw), np.uint16).astype(np.int32)
                ends = np.r_[0, np.cumsum([len(r) // 2 for r in raw])].astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) of every whole text, as the tokenizer's library gives them without truncation, padding or special tokens of its own.

    A first pass counts all words of ``docs``; the ``words`` most frequent ones
    go with their ids into a transducer, a file that Spark ships to every
    executor and workers map into memory. A second pass splits each text as the
    vocabulary's tokenizer does, looks all distinct words of a few documents up
    at once and merges what isn't found, by the same merges. An added token's
    string in a text is that token. Null texts count as empty: no ids. Null or
    repeated doc_ids are rows like any other; other columns are ignored; an
    empty table gives no rows.
    """
    path = path or packing.tokenizer_path()
    shared = build_lexicon(docs, path, words)
    docs.sparkSession.sparkContext.addFile(shared)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded(path, os.path.basename(shared)), "doc_id long, ids array<int>")


def _decoded(path: str):
    @F.pandas_udf("string")
    def run(lists):
        table = _vocabulary(path).bytes_of
        return lists.map(lambda ids: b"".join([table.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace"), na_action="ignore")

    return run


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (ids: array of int) with ``text``: the bytes of all ids as UTF-8, U+FFFD for what isn't; special tokens stay. Unknown ids give nothing, a null list gives null."""
    return tokens.withColumn("text", _decoded(path or packing.tokenizer_path())(F.col("ids").cast("array<int>")))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts that they decode to."""
    got = decode(encode(common.table(spark, sf_dir, "documents")))
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
