"""The token estimate of a column of texts, a batch at a time: Arrow and numpy, no loop over rows. The engine's patterns cost a call per character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many bytes are scanned at a time.
CHUNK = 1 << 21


def chunks(*columns: pa.Array, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[pa.Array, ...]]:
    """The texts of some columns in slices of about ``size`` bytes, at most ``rows`` rows and a row at least."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < len(ends):
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))))
        yield tuple(c.slice(at, end - at) for c in columns)
        at = end


_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _SIGN, np.int8)
_CLASS[[*range(9, 14), 32]] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _OTHER


def _counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text (nulls count as empty), from its bytes: a run of one class has a price by its length."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    begin = offsets[:-1] - first
    kind = _CLASS[data]
    new_row = np.zeros(len(data) + 1, bool)
    new_row[begin] = True
    new_row = new_row[:-1]
    quote = np.flatnonzero(data == 39)
    if len(quote):  # of quotes in a row the first one decides: after a letter, all belong to the word
        head = np.ones(len(quote), bool)
        head[1:] = (quote[1:] != quote[:-1] + 1) | new_row[quote[1:]]
        heads = quote[head]
        in_word = (heads > 0) & ~new_row[heads] & (kind[heads - 1] == _LETTER)
        kind[quote[in_word[np.cumsum(head) - 1]]] = _LETTER
    change = new_row.copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    n = np.diff(start, append=len(data))
    k = kind[start]
    price = np.zeros(len(start), np.int64)
    w = n[k == _LETTER]
    price[k == _LETTER] = np.where(w <= 7, 1, np.where(w <= 12, 2, np.where(w <= 16, 3, 3 + (w - 13) // 4)))
    price[k == _DIGIT] = (n[k == _DIGIT] + 2) // 3
    price[k == _SIGN] = (n[k == _SIGN] + 1) // 2
    other = np.flatnonzero(k == _OTHER)
    if len(other):
        leads = np.concatenate(([0], np.cumsum(data >= 0xC0)))
        price[other] = leads[start[other] + n[other]] - leads[start[other]]
    blank = np.flatnonzero((k == _BLANK) & (n > 1))
    if len(blank):  # a line break is a token, and so are 4 blanks between breaks, and what is left after the last one
        size = n[blank]
        at = np.repeat(start[blank] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        ends = np.cumsum(size)
        breaks = data[at] == 10
        part = np.zeros(len(at), bool)  # where a stretch without a break begins
        run_head = np.zeros(len(at), bool)
        run_head[ends - size] = True
        part[:] = ~breaks & (run_head | np.concatenate(([True], breaks[:-1])))
        run = np.repeat(np.arange(len(size)), size)
        number = np.cumsum(part) - 1
        lengths = np.bincount(number[~breaks], minlength=int(part.sum())) if part.any() else np.zeros(0, np.int64)
        cost = np.bincount(run[breaks], minlength=len(size)) + np.bincount(run[part], lengths // 4, len(size)).astype(np.int64)
        tail = ends - 1
        open_end = ~breaks[tail]
        cost[open_end] += lengths[number[tail[open_end]]] % 4 > 0
        price[blank] = np.maximum(1, cost)
    row = np.searchsorted(begin, start, "right") - 1
    return np.maximum(np.bincount(row, price, len(texts)).astype(np.int64), offsets[1:] > offsets[:-1])


@F.arrow_udf(T.LongType())
def token_count(text: pa.Array) -> pa.Array:
    """The token estimate of ``text.tokens``; null for null, 0 for an empty text."""
    done = [_counts(part) for (part,) in chunks(text)]
    return pa.array(np.concatenate(done) if done else np.zeros(0, np.int64), mask=~pc.is_valid(text).to_numpy(zero_copy_only=False))

