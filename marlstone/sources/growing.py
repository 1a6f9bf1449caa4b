"""JSON lines that a writer is still adding to, as a data source for batches and streams.

    spark.dataSource.register(GrowingJsonLines)
    spark.read.format("growing_json_lines").schema(s).load(path)
    spark.readStream.format("growing_json_lines").schema(s).load(path)

A partition is a range of a file's bytes; it holds the lines that begin in it, so ranges need no
look at the data when they are planned, and no line is read twice or lost. A stream's offset is, for each file,
the byte behind its last whole line: what a writer has begun waits for the next trigger. A batch also takes
the unended last line if it decodes, and ignores it if not; any other line that does not decode raises.

The schema is the caller's: other fields are ignored, absent ones null, blank lines skipped. ``path`` is a
file or a folder (hidden files don't count) on any file system that Arrow knows; option ``chunk`` is a range's size in
bytes. An offset has an entry a file: it is meant for logs, not for folders of millions of files.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyarrow import json as arrow_json
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 8 << 20
BLOCK = 1 << 16


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of an address and the path on it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's visible files, in order."""
    system, own = opened(path)
    info = system.get_file_info(own)
    if info.type == arrow_fs.FileType.File:
        return [(path, info.size)]
    lead = path[: len(path) - len(own)] if path.endswith(own) else ""
    found = system.get_file_info(arrow_fs.FileSelector(own, allow_not_found=True, recursive=True))
    return sorted((lead + x.path, x.size) for x in found if x.type == arrow_fs.FileType.File and not x.base_name.startswith((".", "_")))


def behind_line(f, at: int, size: int) -> int:
    """The place behind the first line end at or after a byte; ``size`` if there is none."""
    f.seek(at)
    while at < size:
        block = f.read(min(BLOCK, size - at))
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return size


def whole_lines(path: str, size: int) -> int:
    """How many of a file's first ``size`` bytes are whole lines: read from the end."""
    system, own = opened(path)
    with system.open_input_file(own) as f:
        end = size
        while end > 0:
            begin = max(0, end - BLOCK)
            f.seek(begin)
            found = f.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return 0


class Span(InputPartition):
    """Lines of a file that begin in [begin, end); all bytes before ``size`` are whole lines, unless ``unended``."""

    def __init__(self, path: str, begin: int, end: int, size: int, unended: bool = False) -> None:
        self.path, self.begin, self.end, self.size, self.unended = path, begin, end, size, unended


def spans(path: str, begin: int, end: int, chunk: int) -> list[Span]:
    return [Span(path, b, min(b + chunk, end), end) for b in range(begin, end, chunk)]


class _Format(NamedTuple):
    schema: StructType
    chunk: int

    def lines(self, span: Span) -> Iterator[pa.RecordBatch]:
        """The span's lines, decoded together."""
        from pyspark.sql.pandas.types import to_arrow_schema

        system, own = opened(span.path)
        with system.open_input_file(own) as f:
            begin = behind_line(f, span.begin - 1, span.size) if span.begin and not span.unended else span.begin
            end = span.size if span.unended or span.end >= span.size else behind_line(f, span.end - 1, span.size)
            f.seek(begin)
            data = f.read(max(0, end - begin))
        if not data.strip():
            return
        shape = to_arrow_schema(self.schema)
        rules = arrow_json.ParseOptions(explicit_schema=shape, newlines_in_values=False, unexpected_field_behavior="ignore")
        try:
            table = arrow_json.read_json(io.BytesIO(data), arrow_json.ReadOptions(use_threads=False, block_size=len(data) + 1), rules)
        except pa.ArrowInvalid as e:
            if span.unended:
                return
            raise ValueError(f"{span.path}: a line between bytes {begin} and {end} does not decode: {e}") from e
        yield from table.select(shape.names).cast(shape).to_batches()


class GrowingJsonLines(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "growing_json_lines"

    def schema(self) -> str:
        raise ValueError("growing_json_lines needs a schema")

    def _format(self, schema: StructType) -> _Format:
        return _Format(schema, int(self.options.get("chunk", CHUNK)))

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(self.options["path"], self._format(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options["path"], self._format(schema))


class BatchReader(DataSourceReader):
    """What is there now."""

    def __init__(self, path: str, how: _Format) -> None:
        self.path, self.how = path, how

    def partitions(self) -> list[Span]:
        out = []
        for path, size in files_of(self.path):
            whole = whole_lines(path, size)
            out += spans(path, 0, whole, self.how.chunk)
            if whole < size:
                out.append(Span(path, whole, size, size, unended=True))
        return out or [Span(self.path, 0, 0, 0, unended=True)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.how.lines(partition) if partition.size else iter(())


class StreamReader(DataSourceStreamReader):
    """What has been added since the last offset; a file that has become shorter raises."""

    def __init__(self, path: str, how: _Format) -> None:
        self.path, self.how = path, how

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {path: whole_lines(path, size) for path, size in files_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        for path in start:
            if end.get(path, 0) < start[path]:
                raise ValueError(f"{path} has become shorter than what was read of it")
        return [x for path, stop in end.items() if stop > start.get(path, 0) for x in spans(path, start.get(path, 0), stop, self.how.chunk)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.how.lines(partition)

    def commit(self, end: dict) -> None:
        """Nothing to forget: files stay as they are."""
