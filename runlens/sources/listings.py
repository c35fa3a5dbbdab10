"""File listings: `stat` text and real directories -> (path, size, mtime) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import let, strip_ws
from runlens.operators.common import exploded, join_spread
from runlens.sources.file_listing import FileListingSource


def parse_listing(lines: DataFrame, line: str = "line", separator: str = "|") -> DataFrame:
    """Rows of `mtime<sep>size<sep>path` lines; the path may contain the separator.

    Lines with fewer fields or fields that are not whole numbers are skipped.
    """
    keys = [c for c in lines.columns if c != line]
    fields = F.split(strip_ws(F.col(line)), r"\|" if separator == "|" else separator, 3)

    def record(f: Column) -> Column:
        parsed = F.struct(
            F.get(f, F.lit(2)).alias("path"), _whole_number(f, 1).alias("size"), _whole_number(f, 0).alias("mtime")
        )
        return F.when(F.size(f) == 3, let(parsed, lambda r: F.when(r["size"].isNotNull() & r["mtime"].isNotNull(), r)))

    return exploded(lines, keys, F.array(let(fields, record)), "_r").select(*keys, "_r.*")


def _whole_number(fields: Column, i: int) -> Column:
    text = strip_ws(F.get(fields, F.lit(i)))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def parse_log_listing(
    lines: DataFrame, block: str = "block", line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """Trace files of complete blocks of `mtime size path` lines.

    A block without its end marker is discarded whole; lines after the marker do not count.
    """
    text = strip_ws(F.col(line))
    ends = lines.where(text == fv.END_MARKER).groupBy(block).agg(F.min(line_no).alias("_end"))
    rows = parse_listing(
        join_spread(lines, ends, block, by=line_no).where(F.col(line_no) < F.col("_end")).drop("_end", line_no),
        line, " ",
    )
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("name", name).where(F.endswith("name", F.lit(fv.TRACE_SUFFIX)))


def split_sections(
    lines: DataFrame, payload: str = "payload_id", line_no: str = "line_no", line: str = "line"
) -> tuple[DataFrame, DataFrame]:
    """(lines with their section, broken payloads).

    A payload lists reports, then work logs, then summaries, set apart by marker lines, up to the
    end marker. Marker positions are one small aggregate per payload, so no window runs over a
    payload however long it is. A payload without both markers in order is reported as broken.
    """
    text = strip_ws(F.col(line))
    at = lambda marker: F.min(F.when(text == marker, F.col(line_no)))
    marks = (
        lines.groupBy(payload)
        .agg(at(fv.WORKLOG_MARKER).alias("_w"), at(fv.SUMMARY_MARKER).alias("_s"), at(fv.END_MARKER).alias("_e"))
        .withColumn("_ok", F.coalesce(
            (F.col("_w") < F.col("_s")) & (F.col("_e").isNull() | (F.col("_s") < F.col("_e"))), F.lit(False)
        ))
    )
    no = F.col(line_no)
    section = (
        F.when(no < F.col("_w"), "report")
        .when((no > F.col("_w")) & (no < F.col("_s")), "worklog")
        .when((no > F.col("_s")) & (F.col("_e").isNull() | (no < F.col("_e"))), "summary")
    )
    sectioned = (
        join_spread(lines, marks.where("_ok"), payload, by=line_no)
        .withColumn("section", section)
        .where(F.col("section").isNotNull())
        .drop("_w", "_s", "_e", "_ok")
    )
    broken = marks.where(~F.col("_ok")).select(payload, F.lit("missing-section-marker").alias("problem"))
    return sectioned, broken


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size, mtime) of the files in a directory; contents are never read."""
    spark.dataSource.register(FileListingSource)
    return spark.read.format("file_listing").option("recursive", str(recursive).lower()).load(root)


def list_users(names: DataFrame, name: str = "name") -> DataFrame:
    """Distinct usable user names of a top-level directory listing, sorted."""
    user = strip_ws(F.col(name))
    return (
        names.select(user.alias("user_id"))
        .where((F.col("user_id") != "") & ~F.contains("user_id", F.lit("/")) & ~F.col("user_id").isin(".", ".."))
        .distinct()
        .orderBy("user_id")
    )
