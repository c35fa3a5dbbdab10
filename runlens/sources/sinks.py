"""Writers. Parquet tables are partitioned by date; documents are JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_COLUMNS = ("case_id", "attempt", "marker", "seq", "at", "error", "failure_kind", "result")


def ledger_rows(runs: DataFrame) -> DataFrame:
    """Marker rows for finished runs: (case, attempt, marker, seq, at, error, failure_kind, result).

    `seq` tells markers of one attempt apart, such as several replies of a trace; 0 where `runs` has none.
    """
    have = set(runs.columns)
    result = [c for c in runs.columns if c not in LEDGER_COLUMNS and c not in ("outcome", "run_date")]
    marker = F.col("marker") if "marker" in have else F.col("outcome")
    optional = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    return runs.select(
        "case_id", "attempt", marker.alias("marker"),
        (F.coalesce("seq", F.lit(0)) if "seq" in have else F.lit(0)).cast("bigint").alias("seq"), "at",
        optional("error"), optional("failure_kind"),
        F.when(marker == "complete", F.to_json(F.struct(*result)) if result else F.lit("{}")).alias("result"),
        F.date_format("at", "yyyy-MM-dd").alias("run_date"),
    )


def append_ledger(runs: DataFrame, path: str, batch: str) -> None:
    """Add the markers of one batch. Writing a batch again replaces it, so a retry does not duplicate."""
    rows = ledger_rows(runs).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "batch").parquet(path)


def write_ledger_batch(runs: DataFrame, batch_id: int, path: str) -> None:
    """The same for a micro-batch of a stream, into the same layout."""
    append_ledger(runs, path, f"stream-{batch_id}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Markers of all batches, one row per (case, attempt, marker, seq): the latest by time, of one time that of the last batch."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
    keys = ["case_id", "attempt", "marker", "seq"]
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    # numbers of batches in order of their length, so that batch 10 comes after batch 9; equal rows decide by content
    latest = F.struct("at", F.length("batch"), "batch", F.to_json(F.struct(*rest)))
    kept = rows.withColumn("seq", F.coalesce("seq", F.lit(0))).groupBy(*keys).agg(F.max_by(F.struct(*rest), latest).alias("row"))
    return kept.select(*keys, "row.*")


def write_sorted(documents: DataFrame, keys: Sequence[str], path: str) -> None:
    """Document rows as JSON lines in the order of `keys`, across and inside files."""
    write_documents(documents.repartitionByRange(*keys).sortWithinPartitions(*keys), path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Manifest or hand-off documents as JSON lines; absent fields are written as null."""
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(texts: DataFrame, path: str, by: str = "run_date") -> None:
    """Prompt and reply texts (case_id, tag, text, run_date)."""
    texts.write.mode("append").partitionBy(by).parquet(path)
