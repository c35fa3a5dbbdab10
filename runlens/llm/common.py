"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runlens import session
from runlens.functions.text import let
from runlens.session import durable

__all__ = [
    "checkpoint_folder", "durable", "durable_table", "fitted", "let", "pure", "rows", "scan_prefix", "schema_with", "table",
    "tasks_for",
]

#: Rows that a Python worker holds as objects at a time.
SLICE = 256

#: Small rows, such as a link or the length of a piece, that are worth a task.
TASK_ROWS = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(df: DataFrame) -> str:
    return session.checkpoint_folder(df.sparkSession)


def durable_table(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the same folder: smaller than a checkpoint, and read by column."""
    path = f"{checkpoint_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(n_rows: int) -> int:
    return max(1, -(-n_rows // TASK_ROWS))


def fitted(df: DataFrame, n_rows: int) -> DataFrame:
    """`df` in no more partitions than so many small rows are worth, as each task of a shuffle writes files of its own."""
    return df.coalesce(tasks_for(n_rows))


def schema_with(df: DataFrame, ddl: str, column: str = "id") -> StructType:
    """`column` of `df` as it is, followed by the fields of `ddl`."""
    return StructType([StructField(column, df.schema[column].dataType), *StructType.fromDDL(ddl).fields])


def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python tuples, a bounded slice at a time."""
    for start in range(0, batch.num_rows, SLICE):
        part = batch.slice(start, SLICE)
        yield from zip(*(c.to_pylist() for c in part.columns))


def pure(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names that an operator uses inside."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def scan_prefix(
    values: Column, first: Column | int, block: int = 256, add: Callable[[Column, Column], Column] = operator.add
) -> Column:
    """Running totals of an array of integers before each element, starting with `first`.

    Two levels keep the work near linear for arrays of up to some hundred thousand elements. `add` may be any
    associative function for which 0 changes nothing, such as the greater one of numbers from 0 on.
    """
    zero = F.lit(0).cast("long")

    def scan(array: Column, start: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
        return F.aggregate(array, F.array(start), step)

    def two_levels(v: Column) -> Column:
        last = F.floor((F.size(v) + block - 1) / block).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * block + 1, F.lit(block)))

        def inside(b: Column) -> Column:
            sums = F.transform(b, lambda x: F.aggregate(x, zero, lambda acc, y: add(acc, y)))
            return let(scan(sums, F.lit(first).cast("long")), lambda starts: F.flatten(
                F.transform(b, lambda x, k: let(scan(x, F.get(starts, k)), lambda s: F.slice(s, F.lit(1), F.size(x))))))

        return let(blocks, inside)

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) == 0, empty).otherwise(two_levels(v)))
