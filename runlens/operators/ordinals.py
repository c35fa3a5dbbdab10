"""Positions of rows in a global order, without a window over all rows or over one group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.session import durable

#: `monotonically_increasing_id` has the partition above these bits and the row's place in it below.
_BITS = 33


def with_ordinal(df: DataFrame, order: Sequence[str | Column], groups: Sequence[str] = (), name: str = "ordinal") -> DataFrame:
    """`df` with the place, from 0 on, of each row in `order`, counted for each group alone if `groups` are named.

    Rows are range-sorted, written, and numbered by their place in the range and the number of rows in the ranges
    before: a count per range is all that meets in one place. A group of any size is many ranges; its rows are
    numbered from the smallest number it has. Rows equal in `order` stand in the order of a hash of all
    their columns, so even a third of all rows with one key is spread.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups] + [o.asc() if isinstance(o, Column) else F.asc(o) for o in order] + [F.xxhash64(*df.columns).asc()]
    placed = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _BITS)
    before, bases = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per range
        bases.append((r["part"], before))
        before += r["n"]
    base = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(base), "_part").select(*df.columns, place.alias(name))
    if not groups:
        return numbered
    first = numbered.groupBy(*[F.col(g).alias(f"_group_{g}") for g in groups]).agg(F.min(name).alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in groups]
    return numbered.join(first, same).select(*df.columns, (F.col(name) - F.col("_first")).alias(name))
