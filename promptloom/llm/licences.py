"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .licence_texts import LINES, NOTICES, OPENINGS, TEXTS

#: Words are hashed to 2**18 features; their document frequencies are counted over all documents.
FEATURE_BITS = 18
#: Least cosine of a window, and of an identifier line, whose two words must both be there; share of a text's words that a whole licence must fill for a licence file;
#: before which word a licence's opening must begin for that.
LEAST, LEAST_LINE, FILLED, AT_START = 0.7, 0.999, 0.5, 50
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_FILE_NAME = re.compile(r"(?i)^(?:un)?(?:licen[cs]e|copying)(?:[-._].*)?$")


class _Features(dict):
    """The feature of each word; frequent words are hashed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word) >> (64 - FEATURE_BITS)
        return got


def features(text: bytes, known: dict) -> np.ndarray:
    """The features of all words of a text, in order; line ends and comment marks are between words."""
    words = _WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Matcher:
    """The best window of a text for each template. ``df``: documents with a feature, of ``n``.

    A window has as many words as the template (or all of a shorter text). Its
    vector holds count times idf for every word, in the template or not.
    """

    def __init__(self, df: np.ndarray, n: int) -> None:
        self.idf = np.log((1 + n) / (1 + df)) + 1
        known = _Features()
        kinds = [(name, kind, t) for kind, of in (("line", LINES), ("notice", NOTICES), ("text", TEXTS), ("opening", OPENINGS)) for name, texts in of.items() for t in texts]
        self.names, self.kinds, texts = zip(*sorted(kinds), strict=True)
        ids = [features(t.encode(), known) for t in texts]
        self.lengths = [len(i) for i in ids]
        vocabulary = np.unique(np.concatenate(ids))
        self.place = np.full(1 << FEATURE_BITS, len(vocabulary), np.int64)  # the last place: a word of no template
        self.place[vocabulary] = np.arange(len(vocabulary))
        self.units = np.zeros((len(ids), len(vocabulary) + 1))
        for row, i in zip(self.units, ids, strict=True):
            np.add.at(row, self.place[i], self.idf[i])
        self.units /= np.sqrt((self.units**2).sum(1))[:, None]
        self.squares = self.units**2

    def windows(self, ids: np.ndarray) -> list[tuple[int, float, int]]:
        """(template, cosine, first word) of the best window of each template that has one of cosine ``LEAST`` (``LEAST_LINE``) or more."""
        if not len(ids):
            return []
        at = self.place[ids]
        met = np.zeros(self.units.shape[1])
        met[at] = 1
        met[-1] = 0
        possible = np.flatnonzero(self.squares @ met >= LEAST**2 - 1e-9)  # shared words alone bound the cosine
        if not len(possible):
            return []
        weight = self.idf[ids]
        squares = np.r_[0, np.cumsum(weight**2)]
        found = []
        for t in possible:
            n = min(self.lengths[t], len(ids))
            dots = np.r_[0, np.cumsum(self.units[t][at] * weight)]
            dot = dots[n:] - dots[:-n]
            bound = dot / np.sqrt(squares[n:] - squares[:-n])  # repeated words only make a vector longer
            best, where = 0.0, -1
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < max(LEAST, best) - 1e-9:
                    break
                part, counts = np.unique(ids[i : i + n], return_counts=True)
                cosine = float(dot[i] / np.sqrt(((counts * self.idf[part]) ** 2).sum()))
                if cosine > best + 1e-9 or (cosine > best - 1e-9 and i < where):
                    best, where = max(best, cosine), int(i)
            if best >= (LEAST_LINE if self.kinds[t] == "line" else LEAST) - 1e-9:
                found.append((int(t), best, where))
        return found

    def scan(self, ids: np.ndarray, named: bool) -> tuple[str | None, float | None, str | None, float | None]:
        """(licence, cosine) of the best window of all, and of the best one that makes the text a licence file."""
        own: tuple = (None, None)
        whole: tuple = (None, None)
        for t, cosine, at in self.windows(ids):
            if own[1] is None or cosine > own[1] + 1e-9:
                own = (self.names[t], cosine)
            kind = self.kinds[t]
            if kind not in ("notice", "line") and (named or (kind == "text" and self.lengths[t] >= FILLED * len(ids)) or (kind == "opening" and at < AT_START)):
                if whole[1] is None or cosine > whole[1] + 1e-9:
                    whole = (self.names[t], cosine)
        return (*own, *whole)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, df, n = _Features(), np.zeros(1 << FEATURE_BITS, np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = [np.unique(features(t, known)) for t in batch.column(0).slice(at, 200).to_pylist() if t]
            if part:
                df += np.bincount(np.concatenate(part), minlength=len(df))
        n += batch.num_rows
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["feature", "n"])


def _scan(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        kinds = (pa.string(), pa.float64(), pa.string(), pa.float64())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [matcher.scan(features(t or b"", known), bool(p) and bool(_FILE_NAME.match(p.rsplit("/", 1)[-1]))) for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                cols = [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]
                yield pa.record_batch([part.column(0), part.column(1), *cols], names=["doc_id", "path", "own", "cosine", "file", "file_cosine"])

    return run


def scan(docs: DataFrame, path: Column) -> DataFrame:
    """The licence of every document: its own text's, or that of the nearest licence file in a directory above.

    ``docs``: doc_id long, text string; ``path``: a column with '/' between
    directories. Word frequencies are those of all documents, by 2**18 hashed
    features. Every window of a text that is as long as a template, over line
    ends and comment marks, is compared with it; a TF-IDF cosine of 0.7 or more
    is a match, and a document's own licence is its best one (ties: the first by
    name). A document is a licence file for its directory if a licence's text
    fills half of it, if it begins with a long licence's opening, or if its name
    says so and it holds either (of several files the best cosine, then the
    smallest doc_id). A document without a licence of its own takes that of the
    file in its directory or, failing that, the nearest one above.

    Null texts count as empty; a null path inherits nothing and gives
    nothing. Null or repeated doc_ids are rows like any other; other columns
    are ignored; an empty table gives no rows. Returns doc_id, path, licence,
    basis (file, header, inherited or none), cosine (of the best window, null
    without a match), from_dir.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col("text").cast("binary").alias("text"))
    counts = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # one row per feature
    df = np.zeros(1 << FEATURE_BITS, np.int64)
    seen = counts[counts["feature"] >= 0]
    df[seen["feature"].to_numpy()] = seen["n"].to_numpy()
    matcher = Matcher(df, int(counts.loc[counts["feature"] < 0, "n"].sum()))
    noted = rows.mapInArrow(_scan(matcher), "doc_id long, path string, own string, cosine double, file string, file_cosine double")
    above_name = F.expr("substring(path, 1, greatest(0, length(path) - length(substring_index(path, '/', -1)) - 1))")
    noted = common.staged(noted.withColumn("dir", above_name), "licences")
    files = noted.where("file is not null and path is not null").groupBy("dir").agg(F.max(F.struct("file_cosine", (-F.col("doc_id")).alias("neg"), "file")).alias("f")).select(F.col("dir").alias("up"), F.col("f.file").alias("licence"))
    dirs = noted.where("own is null and path is not null").groupBy("dir").agg(F.count("*").alias("docs"))
    parents = "transform(sequence(0, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))"
    above = common.staged(dirs.select("dir", "docs", F.explode(F.array_distinct(F.expr(parents))).alias("up")), "above")
    files = common.staged(files.join(above.groupBy("up").agg(F.count("*").alias("below")), "up"), "files")
    near = common.join_by_key(above, files, "up", "below").groupBy("dir").agg(F.max_by(F.struct("licence", "up"), F.length("up")).alias("x"), F.max("docs").alias("docs"))
    near = common.staged(near.select("dir", F.col("x.licence").alias("inherited"), F.col("x.up").alias("from_dir"), "docs"), "inherited")
    bare = F.col("own").isNull() & F.col("path").isNotNull()
    heirs = common.join_by_key(noted.where(bare), near, "dir", "docs", "left").drop("docs")
    none = F.lit(None).cast("string")
    out = noted.where(~bare).select("*", none.alias("inherited"), none.alias("from_dir")).unionByName(heirs)
    licence = F.coalesce("file", "own", "inherited")
    basis = F.when(F.col("file").isNotNull(), "file").when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", licence.alias("licence"), basis.alias("basis"), F.round("cosine", 6).alias("cosine"), F.when(basis == "inherited", F.col("from_dir")).alias("from_dir"))


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment: its directories."""
    return F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "[?#].*$", "")


def scan_pages(pages: DataFrame) -> DataFrame:
    """The scan of web pages (page_id, url, html) in the directories of their URLs."""
    return scan(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), "url"), url_path(F.col("url")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table has no paths: a document lies in source/language/thousands of its id."""
    docs = common.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.expr("cast(doc_id div 1000 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs, path)
