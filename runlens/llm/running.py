"""Running totals within groups over rows in a global order, without a window over a whole group.

Rows are range-sorted, so a group may lie in many partitions. One pass takes a row per partition: its first and last
group, and the last group's totals so far. From these follow the totals that each partition starts with, and a
second pass adds up. A task holds a batch at a time, and the driver a row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField, StructType

from runlens.llm.common import durable


def _totals(group: np.ndarray, values: np.ndarray, before: tuple[int, np.ndarray] | None) -> np.ndarray:
    """Running totals per column, from 0 where a group begins; `before`: the last group so far and its totals."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sums = np.cumsum(values, axis=0)
    base = np.r_[np.zeros((1, values.shape[1]), np.int64), sums][first]
    if before is not None and before[0] == group[0]:
        base[0] -= before[1]
    return sums - np.repeat(base, np.diff(np.r_[first, len(group)]), axis=0)


def _arrays(batch: pa.RecordBatch, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return batch[group].to_numpy(zero_copy_only=False), np.stack([batch[c].to_numpy(zero_copy_only=False) for c in names], axis=1)


def running_totals(
    df: DataFrame, group: str, order: list[Column], totals: dict[str, str], before_too: str | None = None,
) -> DataFrame:
    """`df` and a column per entry (new name: column of longs) of `totals`: the total up to the row within its group.

    With `before_too`, a suffix, there is a further column for each: the total without the row itself.
    `group` is a column of longs, not null. Totals wrap around at 64 bits. Rows that are equal in `order` get totals in some
    order. An empty table gives an empty one.
    """
    names = list(totals.values())
    placed = durable(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, before = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if batch.num_rows:
                of, values = _arrays(batch, group, names)
                first = of[0] if first is None else first
                before = of[-1], _totals(of, values, before)[-1]
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (
                part, int(first), int(before[0]), before[1].tolist())], ["part", "first", "last", "totals"])

    start: dict[int, tuple[int, list[int]]] = {}
    last: tuple[int, np.ndarray] | None = None
    found = placed.select(group, *dict.fromkeys(names)).mapInArrow(ends, "part long, first long, last long, totals array<long>")
    for r in sorted(found.collect()):
        mine = np.array(r["totals"], np.int64)
        if last is not None and last[0] == r["first"]:
            start[r["part"]] = last[0], last[1].tolist()
            if r["last"] == r["first"]:
                mine = mine + last[1]
        last = r["last"], mine
    new = [*totals, *(f"{c}{before_too}" for c in totals if before_too)]
    schema = StructType([*placed.schema.fields, *(StructField(c, LongType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = start.get(TaskContext.get().partitionId())
        if before is not None:
            before = before[0], np.array(before[1], np.int64)
        for batch in batches:
            if batch.num_rows:
                of, values = _arrays(batch, group, names)
                sums = _totals(of, values, before)
                before = of[-1], sums[-1]
                out = np.concatenate([sums, sums - values], axis=1)[:, :len(new)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(out[:, k]) for k in range(len(new)))], schema.names)

    return placed.mapInArrow(run, schema)
