"""Joins between paths and the directories above them, as a sweep over sorted paths.

Roots and paths are range-sorted together by a key in which a directory comes right before all that lies below it. A task
walks its range with a stack of the roots that are open at the row, so a path meets its roots without a
row per directory level and without a pairwise join. Which roots are open where a range begins follows from one row per
range: the last key and the roots open there. A directory with most of the files is many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from runlens.functions.paths import is_excluded_path, is_worklog_path
from runlens.operators.common import first_per_key
from runlens.session import durable

_BELOW = "\x00"


def _key(path: Column) -> Column:
    """`path` with the lowest character for slashes, so that `a/b` comes before `a-b`; the character itself is escaped."""
    escaped = F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(escaped, F.lit("/"), F.lit(_BELOW))


def _is_below(key: str, root: str) -> bool:
    return key.startswith(root) and (len(key) == len(root) or key[len(root)] == _BELOW)


def _open_at(stack: list[tuple], key: str) -> None:
    while stack and not _is_below(key, stack[-1][0]):
        stack.pop()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The range's last key and the roots of its own that are open there."""
    stack, last = [], None
    for batch in batches:
        for key, root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _open_at(stack, key)
            if root is not None:
                stack.append((key, root))
            last = key
    if last is not None:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "last": last, "keys": [k for k, _ in stack], "roots": [r for _, r in stack]}],
                                         schema=pa.schema([("part", pa.int64()), ("last", pa.string()), ("keys", pa.list_(pa.string())),
                                                           ("roots", pa.list_(pa.string()))]))


def below(paths: DataFrame, roots: DataFrame, path: str, root: str, every: bool = False, keep_all: bool = False) -> DataFrame:
    """Rows of `paths` at or below a root, with the longest such root; with `every` a row for each such root.

    `roots` has one row per root; null paths and roots match nothing. `keep_all` keeps the rows without a root, with a null.
    Rows of one path are spread over tasks like others.
    """
    row = F.struct(*paths.columns)
    nothing = F.lit(None)
    both = roots.where(F.col(root).isNotNull()).select(
        _key(F.col(root)).alias("key"), F.col(root).alias("root"), nothing.cast(paths.select(row.alias("r")).schema["r"].dataType).alias("row"),
        F.lit(-(2**63)).alias("salt"),
    ).unionAll(paths.where(F.col(path).isNotNull()).select(
        _key(F.col(path)).alias("key"), nothing.cast("string").alias("root"), row.alias("row"), F.xxhash64(*paths.columns).alias("salt")))
    order = [F.asc("key"), F.col("root").isNull(), F.asc("salt")]
    placed = durable(both.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "root", "row"))
    ends = placed.select("key", "root").mapInArrow(_ends, "part long, last string, keys array<string>, roots array<string>")
    start: dict[int, list[tuple]] = {}
    carried: list[tuple] = []
    for r in sorted(ends.collect()):  # a row per range
        start[r["part"]] = list(carried)
        _open_at(carried, r["last"])
        carried += zip(r["keys"], r["roots"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = list(start.get(TaskContext.get().partitionId(), []))
        for batch in batches:
            which, found = [], []
            for k, (key, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                _open_at(stack, key)
                if own is not None:
                    stack.append((key, own))
                    continue
                names = [r for _, r in (stack if every else stack[-1:])] or [None] * keep_all
                which += [k] * len(names)
                found += names
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).take(pa.array(np.array(which, np.int64))), pa.array(found, pa.string())], ["row", "root"])

    kind = placed.schema["row"].dataType
    out = placed.mapInArrow(sweep, StructType([StructField("row", kind), StructField("root", StringType())]))
    found = out.select("row.*", F.col("root").alias(root))
    if keep_all:
        found = found.unionAll(paths.where(F.col(path).isNull()).select("*", nothing.cast("string").alias(root)))
    return found


def longest_root(
    paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root_path", label: str = "root_label",
    keep_all: bool = False,
) -> DataFrame:
    """Rows of `paths` that are at or below a root, with the longest such root and its label.

    `keep_all` keeps the other rows too, with nulls.
    """
    roots = first_per_key(
        roots.select(F.regexp_replace(root, "/+$", "").alias(root), F.col(label)), root, label
    )
    found = below(paths, roots, path, root, keep_all=keep_all)
    return found.join(roots, root, "left").select(*paths.columns, root, label)


def resolve_paths(
    detected: DataFrame, listing: DataFrame, path: str = "remote_path", file_path: str = "path",
    roots: DataFrame | None = None, failed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(matches, status per detected path).

    A detected path matches the listed file of that name; a work-log path that is a directory
    matches all files below it. Excluded paths are not looked up. Paths in `failed` (path, error), whose look-up
    did not come back, match nothing and are `resolve_failed`. Matches are rows, not arrays, so
    a directory with a third of all files stays spread out. With `roots` (root_path, root_label), each match
    carries the longest root above its detected path.
    """
    wanted = detected.select(F.regexp_replace(path, "/+$", "").alias(path)).distinct()
    lookup = wanted.where(~is_excluded_path(F.col(path)))
    if failed is not None:
        errors = first_per_key(failed.select(F.regexp_replace("path", "/+$", "").alias(path), "error"), path, "error")
        lookup = lookup.join(errors, path, "left_anti")
        wanted = wanted.join(errors, path, "left")
    else:
        wanted = wanted.withColumn("error", F.lit(None).cast("string"))
    files = listing.select(file_path, "size", "mtime")
    dirs = is_worklog_path(F.col(path))
    matches = below(files, lookup, file_path, path, every=True).where(dirs | (F.col(file_path) == F.col(path))).select(
        path, file_path, "size", "mtime")
    counts = matches.groupBy(path).agg(F.count(F.lit(1)).alias("n_files"))
    if roots is not None:
        matches = matches.join(longest_root(lookup, roots, path, keep_all=True), path)
    excluded = is_excluded_path(F.col(path))
    status = (
        F.when(excluded, "ignored_internal_workspace")
        .when(F.col("error").isNotNull(), "resolve_failed")
        .when(F.col("n_files").isNotNull(), "found")
        .otherwise("not_found")
    )
    return matches, wanted.join(counts, path, "left").select(
        path, status.alias("status"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.when(~excluded, F.col("error")).alias("error")
    )
