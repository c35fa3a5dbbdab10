"""Streaming stability detection: report a session's listing once it has stopped changing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runlens.functions import fixed_values as fv

OUTPUT = "session_id STRING, poll_no BIGINT, signature STRING"


class _Stable(StatefulProcessor):
    def __init__(self, checks: int) -> None:
        self.checks = max(1, checks)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "signature STRING, run BIGINT, reported BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, run, reported = self.state.get() if self.state.exists() else (None, 0, False)
        if reported:
            return
        polls = pd.concat(list(rows)).sort_values("poll_no")
        for poll in polls.itertuples():
            if not poll.present:
                run = 0
            elif run and poll.signature == last:
                run += 1
            else:
                run = 1
            last = poll.signature
            if run >= self.checks:
                self.state.update((last, run, True))
                yield pd.DataFrame({"session_id": [key[0]], "poll_no": [poll.poll_no], "signature": [last]})
                return
        self.state.update((last, run, False))

    def close(self) -> None:
        pass


class _StableInTime(StatefulProcessor):
    """Polls wait in a map until the watermark has passed their time, so that none before them can come any more."""

    def __init__(self, checks: int, retention_seconds: int) -> None:
        self.checks, self.retention_ms = max(1, checks), retention_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "signature STRING, run BIGINT, reported BOOLEAN, expires BIGINT")
        self.waiting = handle.getMapState("waiting", "poll_no BIGINT", "signature STRING, present BOOLEAN, at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (None, 0, False, None)
        last = None
        for part in rows:
            for poll in part.itertuples():
                at = int(poll.at.value // 1_000_000)
                last = at if last is None else max(last, at)
                if not known[2]:
                    self.waiting.updateValue((poll.poll_no,), (poll.signature, bool(poll.present), at))
                    self.handle.registerTimer(at)
        if last is not None and (known[3] is None or last + self.retention_ms > known[3]):
            if known[3] is not None:
                self.handle.deleteTimer(known[3])
            known = (*known[:3], last + self.retention_ms)
            self.handle.registerTimer(known[3])
        self.state.update(known)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        last, run, reported, expires = self.state.get()
        if not reported and self.waiting.exists():
            ready = sorted((number[0], *poll) for number, poll in self.waiting.iterator() if poll[2] <= now)
            for number, signature, present, _ in ready:
                run = 0 if not present else run + 1 if run and signature == last else 1
                last = signature
                self.waiting.removeKey((number,))
                if run >= self.checks:
                    reported = True
                    self.waiting.clear()
                    yield pd.DataFrame({"session_id": [key[0]], "poll_no": [number], "signature": [last]})
                    break
        if due >= expires:
            self.state.clear()
            self.waiting.clear()
        else:
            self.state.update((last, run, reported, expires))

    def close(self) -> None:
        pass


def detect_stable(
    polls: DataFrame, checks: int = fv.STABLE_CHECKS, time: str | None = None, lateness: str = "10 minutes",
    retention_seconds: int = 7 * 86400,
) -> DataFrame:
    """First stable poll per session from a stream of (session_id, poll_no, signature, present).

    The batch twin is `stability_runs` with `first_stable_poll`; polls without a session or number have no place in a
    sequence. Without `time`, polls must arrive in order over micro-batches, as a poller writes them, and a small
    row is kept per session for ever. With `time`, a column of timestamps that rise with the numbers, they may
    arrive in any order up to `lateness`: each waits until the watermark has passed it, and a session is forgotten
    `retention_seconds` after its last poll. Polls without a time have no place either then.
    """
    placed = polls.where(F.col("session_id").isNotNull() & F.col("poll_no").isNotNull())
    columns = ["session_id", "poll_no", "signature", F.coalesce("present", F.lit(False)).alias("present")]
    if time is None:
        return placed.select(*columns).groupBy("session_id").transformWithStateInPandas(_Stable(checks), OUTPUT, "Append", "None")
    timed = placed.where(F.col(time).isNotNull()).select(*columns, F.col(time).alias("at"))
    return timed.withWatermark("at", lateness).groupBy("session_id").transformWithStateInPandas(
        _StableInTime(checks, retention_seconds), OUTPUT, "Append", "EventTime")
