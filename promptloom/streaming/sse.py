"""Event streams of models as a streaming source: ``spark.readStream.format("sse")`` over a folder of captures that grow.

A capture is a file to which the bytes of one response are appended as they come. The source gives chunks of bytes, cut
anywhere; ``lines`` puts them together again, with what a chunk leaves of a line carried over in the stream's state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources import library

#: Bytes of a chunk at most.
CHUNK = 1 << 20


def _folder(path: str):
    """(file system, path within it) of a folder that any worker reaches."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a capture."""

    def __init__(self, name: str, start: int, end: int) -> None:
        super().__init__(name)
        self.name, self.start, self.end = name, start, end


class CaptureReader(DataSourceStreamReader):
    """The offset is how much of each file has been read. Files are only appended to, so the same two offsets always give the same bytes, and a batch that is run again is the same batch."""

    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, folder = _folder(self.path)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(name, at, min(at + self.chunk, size)) for name, size in sorted(end.items()) for at in range(start.get(name, 0), size, self.chunk)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, folder = _folder(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as f:
            yield partition.name, partition.start, f.read_at(partition.end - partition.start, partition.start)


class CaptureSource(DataSource):
    """Options: path, chunk (bytes). Rows: stream (the file's name), at (where its bytes begin), bytes."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "stream string, at long, bytes binary"

    def streamReader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def captures(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The stream of chunks of a folder of captures."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("sse").option("path", path).option("chunk", str(chunk)).load()


def _whole(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Complete lines; the bytes after the last newline wait for the next chunk."""
    at, rest = state.get if state.exists else (0, b"")
    chunks = sorted((int(a), bytes(b)) for f in frames for a, b in zip(f["at"], f["bytes"], strict=True))
    *whole, left = b"".join([bytes(rest), *(b for _, b in chunks)]).split(b"\n")
    out = []
    for line in whole:
        out.append((key[0], at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    state.update((at, left))
    yield pd.DataFrame(out, columns=["stream", "at", "line"])


def lines(chunks: DataFrame) -> DataFrame:
    """(stream, at, line) of chunks (stream, at, bytes): a line comes when its end has come, however it was cut. ``at`` is the byte where it begins."""
    return chunks.groupBy("stream").applyInPandasWithState(_whole, "stream string, at long, line string", "at long, rest binary", "append", GroupStateTimeout.NoTimeout)


def deltas(chunks: DataFrame) -> DataFrame:
    """(stream, at, text): the pieces of text that the data lines of the streams carry; other, closing and malformed lines are passed over."""
    return lines(chunks).select("stream", "at", library.sse_text("line").alias("text")).where("text <> ''")
