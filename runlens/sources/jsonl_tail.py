"""Python data source `jsonl_tail`: the lines appended to files since given byte offsets.

Spark's file sources never revisit a file they have seen, so they cannot follow a growing log.
Batch reads cut every file into byte ranges; a range owns the lines that start in it. Streaming
reads remember one offset per file and leave an unfinished last line for the next batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual,
)

_SCHEMA = pa.schema([("trace", pa.string()), ("byte_offset", pa.int64()), ("line", pa.string())])
_BATCH_BYTES = 4 << 20
_SPLIT_BYTES = 128 << 20


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    owns_first_line: bool  # False: the line that spans `start` belongs to the range before
    filtered: bool = False  # `start` is a filter on the offset: carriage returns end lines there too


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path inside it; a path without a scheme, or with file:, is local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def as_uri(location: str, path: str) -> str:
    """Full name of a file found below a location; local files go by their plain path."""
    if location.startswith("file:") or "://" not in location:
        return path
    scheme, rest = location.split("://", 1)
    # an object store's paths start with the bucket, a cluster's paths lack the host
    host = "" if scheme.startswith(("s3", "gs")) else rest.split("/", 1)[0] + "/"
    return f"{scheme}://{host}{path.lstrip('/')}"


def list_sizes(location: str, suffix: str) -> dict[str, int]:
    """Size of every file with the suffix at or below a location."""
    system, root = filesystem(location)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {as_uri(location, root): info.size}
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {
        as_uri(location, f.path): f.size
        for f in found if f.type == fs.FileType.File and f.path.endswith(suffix)
    }


def split_ranges(path: str, start: int, end: int, split_bytes: int) -> list[ByteRange]:
    return [
        ByteRange(path, at, min(at + split_bytes, end), at == start)
        for at in range(start, end, split_bytes)
    ]


def _lines(part: ByteRange, whole_lines_only: bool) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line) of the lines that start in the range."""
    system, path = filesystem(part.path)
    with system.open_input_file(path) as stream:
        at = part.start
        if part.owns_first_line:
            stream.seek(at)
        else:
            # start one byte early: a line break just before the range means a line starts in it
            at -= 1
            stream.seek(at)
        skipping = not part.owns_first_line
        unfinished: list[bytes] = []
        while chunk := stream.read(_BATCH_BYTES):
            pieces = chunk.split(b"\n")
            if len(pieces) == 1:
                unfinished.append(chunk)
                continue
            pieces[0] = b"".join([*unfinished, pieces[0]])
            unfinished = [pieces.pop()]
            for piece in pieces:
                if skipping:
                    skipping = False
                    if part.filtered:
                        yield from _after_carriage_return(at, piece)
                elif at >= part.end:
                    return
                else:
                    yield from _by_carriage_return(at, piece)
                at += len(piece) + 1
            if at >= part.end and not skipping:
                return
        if not skipping and at < part.end and not whole_lines_only:
            yield from _by_carriage_return(at, b"".join(unfinished))
        elif skipping and part.filtered and not whole_lines_only:
            yield from _after_carriage_return(at, b"".join(unfinished))


def _after_carriage_return(at: int, piece: bytes) -> Iterator[tuple[int, bytes]]:
    """Lines of the piece but the one it begins with, which starts earlier."""
    skipped = piece.find(b"\r") + 1
    if skipped:
        yield from _by_carriage_return(at + skipped, piece[skipped:])


def _by_carriage_return(at: int, piece: bytes) -> Iterator[tuple[int, bytes]]:
    for line in piece.split(b"\r"):
        if line:
            yield at, line
        at += len(line) + 1


def _batches(part: ByteRange, whole_lines_only: bool = False) -> Iterator[pa.RecordBatch]:
    offsets: list[int] = []
    lines: list[str] = []
    held = 0
    for at, line in _lines(part, whole_lines_only):
        offsets.append(at)
        lines.append(line.decode("utf-8", "replace"))
        held += len(line)
        if held >= _BATCH_BYTES:
            yield _batch(part.path, offsets, lines)
            offsets, lines, held = [], [], 0
    if offsets:
        yield _batch(part.path, offsets, lines)


def _batch(path: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())],
        schema=_SCHEMA,
    )


class JsonlTailSource(DataSource):
    """Options: path, suffix (`.jsonl`), startOffsets (JSON map file -> byte), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "trace STRING, byte_offset BIGINT, line STRING"

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Options:
    def __init__(self, options) -> None:
        self.location = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.start_offsets = json.loads(options.get("startOffsets", "{}"))
        self.split_bytes = int(options.get("splitBytes", _SPLIT_BYTES))

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[ByteRange]:
        return [
            part
            for path, size in sorted(end.items())
            for part in split_ranges(path, max(0, min(start.get(path, 0), size)), size, self.split_bytes)
        ]


class _BatchReader(DataSourceReader):
    """Filters on the file and lower and upper bounds of the byte offset decide which ranges are read at all."""

    def __init__(self, options) -> None:
        self.opts = _Options(options)
        self.files: set[str] | None = None
        self.first, self.end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("trace",) and isinstance(f, (EqualTo, In)):
                files = set(f.value if isinstance(f, In) else [f.value])
                self.files = files if self.files is None else self.files & files
            elif column == ("byte_offset",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.end = end if self.end is None else min(self.end, end)
                yield f  # checked again by Spark: a line with carriage returns holds several offsets
            else:
                yield f

    def partitions(self) -> list[ByteRange]:
        sizes = list_sizes(self.opts.location, self.opts.suffix)
        chosen = {p: n for p, n in sizes.items() if self.files is None or p in self.files}
        parts = []
        for part in self.opts.ranges(self.opts.start_offsets, chosen):
            if (self.end is not None and part.start >= self.end) or part.end <= self.first:
                continue
            if part.start < self.first:
                part = ByteRange(part.path, self.first, part.end, False, True)
            parts.append(part)
        return parts or [ByteRange("", 0, 0, True)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.opts = _Options(options)
        self.probed: dict[str, tuple[int, int]] = {}  # file -> (size, end of its last line)

    def initialOffset(self) -> dict:
        return dict(self.opts.start_offsets)

    def latestOffset(self) -> dict:
        for path, size in list_sizes(self.opts.location, self.opts.suffix).items():
            if self.probed.get(path, (-1, 0))[0] != size:
                self.probed[path] = (size, _end_of_last_line(path, size))
        return {path: end for path, (_, end) in self.probed.items()}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return self.opts.ranges(start, end)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return _batches(partition, whole_lines_only=True)


def _end_of_last_line(path: str, size: int) -> int:
    """Offset just after the last line break, found by reading backwards."""
    system, name = filesystem(path)
    with system.open_input_file(name) as stream:
        end = size
        while end > 0:
            begin = max(0, end - 65536)
            stream.seek(begin)
            at = stream.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0
