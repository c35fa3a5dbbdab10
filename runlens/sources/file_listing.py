"""Python data source `file_listing`: (path, size, mtime) of files, empty ones included.

Spark's own file sources leave out files of length zero, which do count as artifacts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runlens.sources.jsonl_tail import as_uri, filesystem

_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.int64())])
_BATCH_ROWS = 10_000
_WANTED_TASKS = 512


@dataclass
class Directory(InputPartition):
    path: str
    recursive: bool


class FileListingSource(DataSource):
    """Options: path, recursive (default true)."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path STRING, size BIGINT, mtime BIGINT"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("recursive", "true") == "true")


class _Reader(DataSourceReader):
    def __init__(self, location: str, recursive: bool) -> None:
        self.location = location
        self.recursive = recursive

    def partitions(self) -> list[Directory]:
        """The tree cut into subtrees: level by level until there is enough work to hand out."""
        system, root = filesystem(self.location)
        if not self.recursive:
            return [Directory(root, False)]
        level, parts = [root], []
        while level and len(level) < _WANTED_TASKS:
            below = []
            for directory in level:
                parts.append(Directory(directory, False))
                found = system.get_file_info(fs.FileSelector(directory, allow_not_found=True))
                below.extend(f.path for f in found if f.type == fs.FileType.Directory)
            level = below
        return parts + [Directory(directory, True) for directory in level]

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.location)
        selector = fs.FileSelector(partition.path, recursive=partition.recursive, allow_not_found=True)
        files = [f for f in system.get_file_info(selector) if f.type == fs.FileType.File]
        for at in range(0, len(files), _BATCH_ROWS):
            rows = files[at:at + _BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([
                pa.array([as_uri(self.location, f.path) for f in rows], pa.string()),
                pa.array([f.size for f in rows], pa.int64()),
                pa.array([f.mtime_ns // 1_000_000_000 if f.mtime_ns else None for f in rows], pa.int64()),
            ], schema=_SCHEMA)
