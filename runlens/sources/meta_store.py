"""Kept metadata of cases: a base and the updates written since, merged when it is read.

Every write is a numbered folder of Parquet files. A reader takes the newest base and the deltas with higher
numbers; a folder counts once Spark has marked its job as successful, so a write that died is not seen. Writing
a number again replaces it, so a repeated batch changes nothing. Compaction writes the merged state as a new base and
leaves the older folders to readers that still use them.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.runs import meta_merge
from runlens.sources.jsonl_tail import filesystem

SCHEMA = "case_id string, field string, value string, seq bigint, write bigint"


def _numbers(path: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind; one entry per write is listed, no file."""
    system, root = filesystem(path.rstrip("/"))
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith(f"{kind}-")]
    done = system.get_file_info([f"{root}/{n}/_SUCCESS" for n in names]) if names else []
    return sorted(int(n.removeprefix(f"{kind}-")) for n, f in zip(names, done) if f.type == fs.FileType.File)


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path.rstrip('/')}/{kind}-{number:010d}"


def append_updates(updates: DataFrame, path: str, number: int) -> bool:
    """Keep field updates (case_id, field, value, seq) as write `number`; False if that write is part of a base already.

    Of one field, the update with the highest `seq` counts, and of equal ones that of the latest write.
    """
    if any(base >= number for base in _numbers(path, "base")):
        return False
    rows = updates.select(
        F.col("case_id").cast("string"), F.col("field").cast("string"), F.col("value").cast("string"), F.col("seq").cast("bigint"),
        F.lit(number).cast("bigint").alias("write"))
    rows.write.mode("overwrite").parquet(_folder(path, "delta", number))
    return True


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, field, value, seq, write): the latest value of every field; empty where nothing is kept yet."""
    base = _numbers(path, "base")[-1:]
    newer = [n for n in _numbers(path, "delta") if not base or n > base[0]]
    folders = [_folder(path, "base", n) for n in base] + [_folder(path, "delta", n) for n in newer]
    rows = spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)
    return meta_merge(rows, order=["seq", "write"])


def compact(spark: SparkSession, path: str) -> int | None:
    """Write the state after the last write as a base, and give its number; None where nothing is kept."""
    numbers = _numbers(path, "delta") + _numbers(path, "base")
    if not numbers:
        return None
    if max(numbers) not in _numbers(path, "base"):
        read_meta(spark, path).write.mode("overwrite").parquet(_folder(path, "base", max(numbers)))
    return max(numbers)
