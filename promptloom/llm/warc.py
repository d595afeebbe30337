"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads from this size on may be revisits. Fixed value.
LEAST_REVISIT = 1000
#: A frame is closed at this many bytes of records, a bundle at this many bytes of payload or records.
FRAME_BYTES, BUNDLE_BYTES, BUNDLE_RECORDS = 1 << 20, 64 << 20, 50_000
#: Fixed values of the seekable format: the skippable frame's magic and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_VERSION = b"WARC/1.1\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, digest: str, size: int, refers: tuple[int, str | None] | None, date: str) -> bytes:
    """One WARC record: a response holds the payload as an HTTP message, a revisit has no block; its headers keep the payload's digest and size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + payload if kind == "response" else b""
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_target(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {size}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {_target(*refers)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers[0]}"]
    return _VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _target(page_id: int | None, url: str | None) -> str:
    return _clean(url) or f"urn:page:{'' if page_id is None else page_id}"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n")


def parse(raw: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and body of the record that begins at ``at``."""
    end = raw.index(b"\r\n\r\n", at)
    if not raw.startswith(_VERSION, at):
        raise ValueError("no WARC record at this offset")
    lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, body


class BundleWriter:
    """Independent frames, then the seek table as a skippable frame with the footer."""

    def __init__(self, out) -> None:
        self.out, self.codec = out, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer = io.BytesIO()

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset within it."""
        at = self.buffer.tell()
        if at and at + len(raw) > FRAME_BYTES:
            self.flush()
            at = 0
        self.buffer.write(raw)
        return len(self.frames), at

    def flush(self) -> None:
        if raw := self.buffer.getvalue():
            packed = self.codec.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw)))
            self.buffer = io.BytesIO()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads the seek table from the end, then any frame by itself."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        count, _, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = source.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", table, 8 * i)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, raw = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=raw)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder's file system, local mount or remote store, by its URI (s3a is the same store as s3)."""
    folder = re.sub("^s3[an]://", "s3://", folder)
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


INDEX = "page_id long, bundle string, frame int, offset long"
_WRITE_COLUMNS = ("page_id", "url", "payload", "digest", "size", "refers_to", "refers_url")


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name = out = writer = None
        index, load = [], 0

        def finish() -> pa.RecordBatch:
            # a bundle gets a name of its own, so a task that runs twice never writes into another's file
            writer.close()
            out.close()
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["page_id", "bundle", "frame", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for page, url, payload, digest, size, refers, refers_url in zip(*(batch.column(i).slice(at, 200).to_pylist() for i in range(7)), strict=True):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)  # the frames are ours
                        writer, index, load = BundleWriter(out), [], 0
                    kind = "response" if refers is None else "revisit"
                    raw = record(page, url, payload, kind, digest, size, None if refers is None else (refers, refers_url), date)
                    index.append((page, name, *writer.add(raw)))
                    load += len(raw)
                    if load >= BUNDLE_BYTES or len(index) >= BUNDLE_RECORDS:
                        yield finish()
                        writer = None
        if writer is not None:
            yield finish()

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        open_as, reader, frame_as, raw = None, None, None, b""
        for batch in batches:
            out = []
            for page, bundle, frame, offset in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle != open_as:
                    open_as, reader, frame_as = bundle, BundleReader(fs.open_input_file(f"{base}/{bundle}")), None
                if frame != frame_as:
                    frame_as, raw = frame, reader.frame(frame)
                head, body = parse(raw, offset)
                body = body.partition(b"\r\n\r\n")[2]
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if head["X-Page-ID"] != ("" if page is None else str(page)):
                    raise ValueError("the index and the archive disagree")
                if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError("a payload doesn't match its digest")
                refers = int(head["X-Refers-To-Page"]) if kind == "revisit" else None
                size = len(body) if kind == "response" else int(head["X-Payload-Bytes"])
                out.append((page, size, digest, kind, refers, body if with_payload and kind == "response" else None))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into bundles in ``folder`` (a folder that all executors share); returns the index.

    The index maps each page_id to its bundle, frame and offset in the frame.
    ``pages``: page_id, url, html; other columns are ignored. ``date``: when
    the pages were captured (every record must have a WARC-Date). A null html
    is an empty payload; a page without a url gets the target urn:page:id. Of
    records with equal payloads of 1000 bytes or more the one with the largest
    page_id is the response, the others revisit it; of rows that repeat that
    page_id all are responses. Rows with a null page_id are always responses.

    Which rows are revisits is found from ids and digests alone; the pages meet
    that list by (page_id, digest), which Spark broadcasts if it is small by
    the size of its files, and shuffles otherwise.
    """
    fs, base = _open(folder)
    fs.create_dir(base)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    keyed = common.staged(rows.where(F.col("size") >= LEAST_REVISIT).select("page_id", "url", "digest", F.sha2("payload", 256).alias("key")), "warc-keys")
    firsts = keyed.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("f"), F.count("*").alias("n")).where("n > 1")
    revisits = common.join_by_key(keyed, common.staged(firsts, "warc-firsts"), "key", "n").where(F.col("page_id") < F.col("f.page_id"))
    revisits = common.staged(revisits.select("page_id", "digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url")).distinct(), "warc-revisits")
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    rows = rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    index = rows.select(*_WRITE_COLUMNS).mapInArrow(_write(folder, date), INDEX)
    return common.staged(index, "warc-index")


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records that ``index`` names, each frame of a bundle once per task; checks digests."""
    near = index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    got = near.select("page_id", "bundle", "frame", "offset").mapInArrow(_read(folder, with_payload), READ)
    return got if with_payload else got.drop("payload")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "warc")
    index = write_archives(common.table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, with_payload=False)


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q
"""
