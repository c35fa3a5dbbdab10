"""Streaming terminal detection: one answer per trace, as soon as it is known.

Emits `stop` or `error` at the first terminal event of the main agent after the baseline, or
`timeout` when none came within the limit, counted in event time from the trace's earliest event.
A terminal event without a time is in time, as in the batch twin
`operators.traces.outcome_with_timeout`. The clock of a trace starts with its first known time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runlens.functions import fixed_values as fv
from runlens.functions.text import iso_timestamp
from runlens.operators.traces import is_terminal
from runlens.sources.jsonl_tail import JsonlTailSource
from runlens.sources.traces import parse_events

OUTPUT = "trace STRING, outcome STRING, started TIMESTAMP, ended TIMESTAMP"
_STATE = "start_ms BIGINT, closed BOOLEAN"


def tail_traces(spark: SparkSession, path: str, start_offsets: str = "{}") -> DataFrame:
    """Stream of the lines appended to the trace files below a directory."""
    spark.dataSource.register(JsonlTailSource)
    return spark.readStream.format("jsonl_tail").option("startOffsets", start_offsets).load(path)


def tail_events(spark: SparkSession, path: str, start_offsets: str = "{}") -> DataFrame:
    """The same, parsed, with `ts` from the event's timestamp."""
    events = parse_events(tail_traces(spark, path, start_offsets))
    return events.withColumn("ts", iso_timestamp(F.col("timestamp")))


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Map-side combine: per trace and batch the time span and the first terminal event.

    A busy trace thus sends a handful of rows to its state instead of all its events.
    """
    for rows in batches:
        if rows.empty:
            continue
        times = rows.groupby("trace", sort=False)["ts"]
        started, latest = times.min(), times.max()
        ends = rows[rows["reason"].notna()].sort_values("byte_offset", kind="stable")
        first = ends.drop_duplicates("trace").set_index("trace")
        yield pd.DataFrame({
            "trace": started.index,
            "ts": latest.values,
            "started": started.values,
            "reason": first["reason"].reindex(started.index).values,
            "end_ts": first["ts"].reindex(started.index).values,
            "end_offset": first["byte_offset"].reindex(started.index).astype("Int64").values,
        })


class _FirstTerminal(StatefulProcessor):
    def __init__(self, timeout_seconds: int, retention_seconds: int) -> None:
        self.timeout_ms, self.retention_ms = timeout_seconds * 1000, retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, closed = self.state.get() if self.state.exists() else (None, False)
        if closed:
            return
        events = pd.concat(list(rows))
        earliest = _ms(events["started"].min())
        if earliest is not None and (start is None or earliest < start):
            if start is not None:
                self.handle.deleteTimer(start + self.timeout_ms)
            start = earliest
            self.handle.registerTimer(start + self.timeout_ms)
        self.state.update((start, False))
        ends = events[events["reason"].notna()].sort_values("end_offset")
        if ends.empty:
            return
        first = ends.iloc[0]
        ended = _ms(first["end_ts"])
        if start is not None:
            self.handle.deleteTimer(start + self.timeout_ms)
        self._settle(start, max(_ms(events["ts"].max()) or 0, timerValues.getCurrentWatermarkInMs()))
        if ended is not None and ended >= start + self.timeout_ms:
            yield _answer(key[0], "timeout", start, start + self.timeout_ms)
        else:
            yield _answer(key[0], first["reason"], start, start if ended is None else ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        start, closed = self.state.get()
        if closed:
            self.state.clear()
            return
        self._settle(start, timerValues.getCurrentWatermarkInMs())
        yield _answer(key[0], "timeout", start, start + self.timeout_ms)

    def _settle(self, start: int | None, now: int) -> None:
        """Keep a marker for a while, so that late events of a settled trace do not reopen it."""
        self.state.update((start, True))
        if now > 0:  # no time is known anywhere before the first event that has one
            self.handle.registerTimer(now + self.retention_ms)

    def close(self) -> None:
        pass


def _ms(at) -> int | None:
    return None if pd.isna(at) else int(pd.Timestamp(at).value // 1_000_000)


def _answer(trace: str, outcome: str, start_ms: int | None, end_ms: int | None) -> pd.DataFrame:
    at = lambda ms: pd.NaT if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc)
    times = {"started": pd.to_datetime([at(start_ms)], utc=True), "ended": pd.to_datetime([at(end_ms)], utc=True)}
    return pd.DataFrame({"trace": [trace], "outcome": [outcome], **times})


def detect_terminal(
    events: DataFrame, timeout_seconds: int = fv.TASK_TIMEOUT_SECONDS, lateness: str = "0 seconds",
    retention_seconds: int = 7 * 86400,
) -> DataFrame:
    """Stream of (trace, outcome, started, ended) from a stream of event rows with `ts`.

    The watermark only moves the event-time timers that report timeouts and forget settled traces.
    A trace that goes on `retention_seconds` after its answer counts as a new one.
    """
    slim = events.select(
        "trace", "byte_offset", "ts", F.when(is_terminal(), F.col("stop_reason")).alias("reason")
    )
    combined = slim.mapInPandas(
        _combine, "trace STRING, ts TIMESTAMP, started TIMESTAMP, reason STRING, end_ts TIMESTAMP, end_offset BIGINT"
    )
    return (
        combined.withWatermark("ts", lateness)
        .groupBy("trace")
        .transformWithStateInPandas(_FirstTerminal(timeout_seconds, retention_seconds), OUTPUT, "Append", "EventTime")
    )
