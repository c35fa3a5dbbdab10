"""JSONL agent traces: text lines -> typed event rows, in file order.

Every event row carries `trace` and an order key, so that "first" and "latest" are plain
aggregates later. Parse once, write Parquet, and read that: no operator parses a line again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import iso_timestamp, let, strip_ws
from runlens.sources.jsonl_tail import JsonlTailSource

_ENVELOPE = (
    "array<struct<event STRING, agent_role STRING, session_id VARIANT, timestamp STRING, payload STRING>>"
)
_PAYLOAD = "assistant STRUCT<stop_reason STRING, content STRING>, tool_name STRING, args STRING"
_STRICT = {"allowSingleQuotes": "false"}


def read_trace_lines(
    spark: SparkSession, path: str, baseline: dict[str, int] | None = None, split_bytes: int | None = None
) -> DataFrame:
    """Lines of trace files as (trace, byte_offset, line); `byte_offset` orders a file's lines.

    `baseline` maps a file to the byte from which it is read; files are cut into byte ranges, so
    one huge trace is read by many tasks. Filters on `trace` and `byte_offset` reach the source, which leaves out
    whole ranges of bytes.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the source has filters, so Spark wants it named
    spark.dataSource.register(JsonlTailSource)
    reader = spark.read.format("jsonl_tail")
    if baseline:
        reader = reader.option("startOffsets", json.dumps(baseline))
    if split_bytes:
        reader = reader.option("splitBytes", str(split_bytes))
    return reader.load(path)


def read_trace_text(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's own text source, for when byte offsets are not needed.

    The order key is taken in the scan's projection: start of the split, then the row number in it.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("trace"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_no"),
        ).alias("line_order"),
        F.col("value").alias("line"),
    )


def envelope(line: Column) -> Column:
    """Struct of a line's top-level fields; null unless the line is exactly one JSON object.

    Wrapped in brackets, trailing garbage and several objects on one line fail to parse as a
    one-element array, which the plain parser would accept.
    """
    def parse(text: Column) -> Column:
        wrapped = F.when(
            F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")),
            F.from_json(F.concat(F.lit("["), text, F.lit("]")), _ENVELOPE, _STRICT),
        )
        return let(wrapped, lambda w: F.when(F.size(w) == 1, F.get(w, F.lit(0))))

    return let(strip_ws(line), parse)


def parse_events(lines: DataFrame, line: str = "line", keep_malformed: bool = False) -> DataFrame:
    """Event columns for every line; malformed lines are dropped, or kept with `malformed`.

    Lines are parsed inside a generator, so filters on the result stay above the parsing and do
    not repeat it.
    """
    keys = [c for c in lines.columns if c != line]

    def fields(e: Column) -> Column:
        payload = e["payload"]
        detail = F.from_json(F.when(F.startswith(payload, F.lit("{")), payload), _PAYLOAD, _STRICT)
        return let(detail, lambda d: F.struct(
            e.isNull().alias("malformed"),
            e["event"].alias("event"),
            e["agent_role"].alias("agent_role"),
            F.try_variant_get(e["session_id"], "$", "string").alias("session_id"),
            F.coalesce(F.schema_of_variant(e["session_id"]) == "STRING", F.lit(False)).alias("session_is_text"),
            e["timestamp"].alias("timestamp"),
            payload.alias("payload"),
            d["assistant"]["stop_reason"].alias("stop_reason"),
            d["assistant"]["content"].alias("content"),
            d["tool_name"].alias("tool_name"),
            d["args"].alias("args"),
        ))

    parsed = lines.select(*keys, F.explode_outer(F.array(let(envelope(F.col(line)), fields))).alias("_e"))
    events = parsed.select(*keys, "_e.*")
    return events if keep_malformed else events.where(~F.col("malformed")).drop("malformed")


def write_events(events: DataFrame, path: str, ts: str = "timestamp", rows_per_file: int = 5_000_000) -> None:
    """Parsed events as Parquet, by day; later reads prune days and skip row groups by offset.

    Rows of a trace stay together in stretches of a gibibyte, so that files are well sorted while a day or a
    trace of any size is still written by as many tasks as there are shuffle partitions.
    """
    day = F.coalesce(F.date_format(iso_timestamp(F.col(ts)), "yyyy-MM-dd"), F.lit("unknown"))
    stretch = F.floor(F.col("byte_offset") / (1 << 30))
    (
        events.withColumn("event_date", day)
        .repartition("event_date", "trace", stretch)
        .sortWithinPartitions("event_date", "trace", "byte_offset")
        .write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path)
    )


def terminal_candidates(lines: DataFrame, line: str = "line", keep_rows: bool = False) -> DataFrame:
    """Cheap superset of the lines that may be terminal events, to run before any JSON parsing.

    JSON may escape any letter, so lines with a backslash-u always pass. With `keep_rows` the other rows stay, with a
    null for the line, so that one pass also knows every trace.
    """
    text = F.col(line)
    maybe = F.contains(text, F.lit("stop_reason")) & F.contains(text, F.lit(fv.MAIN_ROLE))
    passes = maybe | F.contains(text, F.lit("\\u"))
    return lines.withColumn(line, F.when(passes, text)) if keep_rows else lines.where(passes)


def reply_text(content: Column) -> Column:
    """Concatenated `text` of the content items of type text; null when there is no such item."""
    items = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    texts = F.filter(items, lambda i: F.try_variant_get(i, "$.type", "string") == "text")
    joined = F.array_join(
        F.transform(texts, lambda i: F.coalesce(F.try_variant_get(i, "$.text", "string"), F.lit(""))), ""
    )
    return F.when(F.size(texts) > 0, joined)
