"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cols = str | Sequence[str]


def names(cols: Cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def order_key(cols: Cols) -> Column:
    """One comparable column for an order given by one or several columns.

    A single number keeps `max_by` in hash aggregation; several columns become a struct.
    """
    parts = names(cols)
    return F.col(parts[0]) if len(parts) == 1 else F.struct(*parts)


def exploded(df: DataFrame, columns: Sequence[str | Column], array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per non-null array element, with its 0-based position if `pos` is given.

    The outer form keeps Spark from adding a "not empty" filter below the generator, which would
    compute the array twice.
    """
    generated = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*columns, generated).where(F.col(name).isNotNull())


def join_spread(
    big: DataFrame, small: DataFrame, keys: Cols, by: Cols | None = None, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join with a side that has one row per key, when a key of the big side may be huge.

    The small side is repeated once per salt and each big row picks a salt by a hash of its own
    columns, so a hot key is shared by `salts` tasks. The result is that of the plain join, and it is
    not partitioned by the key alone, so an aggregate that follows combines before it shuffles.
    """
    keys = names(keys)
    own = names(by) if by else [c for c in big.columns if c not in keys] or keys
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: Cols, order: Column | str, columns: Cols | None = None) -> DataFrame:
    """First row per key by an order, as a mergeable aggregate rather than a window."""
    keys = names(keys)
    rest = [c for c in (names(columns) if columns else df.columns) if c not in keys]
    row = F.min_by(F.struct(*rest), order)
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, *[f"_row.{c}" for c in rest])

