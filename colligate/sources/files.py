"""Lines with their places, and text in pieces, as data sources.

``colligate_lines`` reads text files as (file, start, value): a file's number, the byte where a line starts, and the line's bytes.
Files are cut into splits at any byte; a split has the lines that start in it. Files come in the order of their names,
also those of a stream, which reads each file once it is there. ``units_of``, ``pairs`` and edges are parsed
from such lines as from others (``lines_of``).

``colligate_pieces`` writes a column of texts one behind the other, without anything between them, so that a line may come
in any number of rows. Each task writes a file in a staging folder; the files of the tasks that succeeded are moved when all are
done, so a task that is repeated leaves nothing behind.

Both reach what ``pyarrow.fs`` reaches from the tasks: shared folders, HDFS, object stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from colligate.errors import OptionError
from colligate.sources.text import BYTES, UTF8

LINES = "file long, start long, value binary"
#: Bytes of a split, of what is read at once, and of lines that are handed on at once.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise OptionError(f"no file system for {path}: {e}") from e


def files_of(path: str) -> list[fs.FileInfo]:
    """The files of a folder, by name, but hidden ones; or the one file."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    if info.type != fs.FileType.Directory:
        raise OptionError(f"no such file or folder: {path}")
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    visible = lambda p: not any(x[:1] in "._" for x in p[len(inner.rstrip("/")) + 1 :].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and visible(f.path)), key=lambda f: f.path)


@dataclass
class Split(InputPartition):
    root: str
    path: str
    file: int
    start: int
    size: int


def splits_of(root: str, files: list[fs.FileInfo], first: int, size: int) -> list[Split]:
    return [Split(root, f.path, first + i, start, size) for i, f in enumerate(files) for start in range(0, max(f.size, 1), size)]


def lines_in(split: Split) -> Iterator[tuple[int, bytes]]:
    """(start, line) of the lines that start in the split, without their line feeds."""
    system, _ = opened(split.root)
    with system.open_input_file(split.path) as f:
        size = f.size()
        at = max(0, split.start - 1)  # a line starts at the split if the byte before it is a line feed
        f.seek(at)
        rest, skip = b"", split.start > 0
        while True:
            data = f.read(READ_BYTES)
            whole = rest + data
            pieces = whole.split(b"\n")
            rest = pieces.pop()
            for line in pieces:
                if skip:
                    skip = False
                elif at >= split.start + split.size:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if not data:
                break
            if not skip and at >= split.start + split.size:
                return
        if rest and not skip and at < min(size, split.start + split.size):
            yield at, rest


def batches_of(split: Split) -> Iterator[pa.RecordBatch]:
    starts, lines, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([split.file] * len(lines), pa.int64()), pa.array(starts, pa.int64()), pa.array(lines, pa.binary())], names=["file", "start", "value"])

    for start, line in lines_in(split):
        starts.append(start)
        lines.append(line)
        size += len(line)
        if size > BATCH_BYTES or len(lines) == 65_536:
            yield batch()
            starts, lines, size = [], [], 0
    if lines:
        yield batch()


class LineReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Split]:
        return splits_of(self.path, files_of(self.path), 0, self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)


class LineStream(DataSourceStreamReader):
    """Files in the order of (time of change, name); the offset is the last one that was read, and how many there were."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def _files(self) -> list[tuple[int, str, fs.FileInfo]]:
        return sorted(((f.mtime_ns or 0, f.path, f) for f in files_of(self.path)), key=lambda x: x[:2])

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "files": 0}

    def latestOffset(self) -> dict:
        found = self._files()
        return {"time": found[-1][0], "path": found[-1][1], "files": len(found)} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = [f for t, p, f in self._files() if (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])]
        return splits_of(self.path, new, start["files"], self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return batches_of(partition)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colligate_lines"

    def schema(self) -> str:
        return LINES

    def _about(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES))

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(*self._about())

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(*self._about())


@dataclass
class Written(WriterCommitMessage):
    staged: str
    name: str


class PieceWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.stage = path.rstrip("/"), overwrite, f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05}"
        staged = f"{inner}/{self.stage}/{name}-{uuid.uuid4().hex}"
        system.create_dir(f"{inner}/{self.stage}", recursive=True)
        with system.open_output_stream(staged) as out:
            for batch in iterator:
                for piece in batch.column(0):
                    out.write(piece.as_buffer())
        return Written(staged, name)

    def commit(self, messages: list[Written]) -> None:
        system, inner = opened(self.path)
        before = [] if system.get_file_info(inner).type == fs.FileType.NotFound else files_of(self.path)
        if self.overwrite:
            for f in before:
                system.delete_file(f.path)
        tag = "" if self.overwrite or not before else f"-{self.stage[8:]}"
        system.create_dir(inner, recursive=True)
        for m in messages:
            if m is not None:
                system.move(m.staged, f"{inner}/{m.name}{tag}")
        self._clean(system, inner)
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, system: fs.FileSystem, inner: str) -> None:
        if system.get_file_info(f"{inner}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.stage}")


class Pieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "colligate_pieces"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema: StructType, overwrite: bool) -> PieceWriter:
        if [f.dataType.typeName() for f in schema] not in (["string"], ["binary"]):
            raise OptionError("pieces are one column of text")
        return PieceWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (Lines, Pieces):
        spark.dataSource.register(source)


def lines_of(rows: DataFrame, encoding: str = UTF8) -> DataFrame:
    """(ord, value) of ``colligate_lines``, batch or stream, to be parsed as units, pairs or edges. What isn't UTF-8 is
    refused, or kept as characters that stand for bytes."""
    text = F.col("value").cast("string")
    fine = F.when(F.is_valid_utf8(text), text).otherwise(F.raise_error(F.concat(F.lit("not UTF-8 (read it as bytes), byte "), F.col("start").cast("string"))))
    return rows.select(F.struct("file", "start").alias("ord"), (F.decode("value", "ISO-8859-1") if encoding == BYTES else fine).alias("value"))


def read_source(spark: SparkSession, path: str, encoding: str = UTF8, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ord, value): the lines of a file or folder, in order."""
    register(spark)
    return lines_of(spark.read.format("colligate_lines").option("split_bytes", split_bytes).load(path), encoding)


def stream_source(spark: SparkSession, path: str, encoding: str = UTF8, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ord, value): the lines of the files that arrive in a folder."""
    register(spark)
    return lines_of(spark.readStream.format("colligate_lines").option("split_bytes", split_bytes).load(path), encoding)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Writes the only column of ``pieces`` as files whose concatenation, by name, is all texts in the order of the partitions."""
    register(pieces.sparkSession)
    pieces.write.format("colligate_pieces").mode("append").save(path)
