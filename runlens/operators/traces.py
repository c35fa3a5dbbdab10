"""Per-trace answers: terminal state, final reply, session, stop counts, creation, timeout.

Input: event rows with a trace column, an order column and the fields of `parse_events`. Each
answer is one aggregate with map-side combine and one shuffle on the trace. Traces without a
qualifying event keep their row, with nulls, because the condition sits inside the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import iso_timestamp, strip_ws
from runlens.operators.common import Cols, join_spread, names, order_key
from runlens.sources.traces import reply_text


def is_terminal(role: str = "agent_role", reason: str = "stop_reason") -> Column:
    return F.coalesce((F.col(role) == fv.MAIN_ROLE) & F.col(reason).isin(*fv.TERMINAL_REASONS), F.lit(False))


def _reason_code(reason: str = "stop_reason") -> Column:
    """1 for stop, 2 for error: a fixed-width aggregate buffer."""
    return F.when(F.col(reason) == fv.TERMINAL_REASONS[0], 1).when(F.col(reason) == fv.TERMINAL_REASONS[1], 2)


def _reason_name(code: Column) -> Column:
    return F.when(code == 1, fv.TERMINAL_REASONS[0]).when(code == 2, fv.TERMINAL_REASONS[1])


def latest_terminal(events: DataFrame, trace: str = "trace", order: Cols = "byte_offset") -> DataFrame:
    """Reason of the latest terminal event of the main agent (null if none), and whether it is stop."""
    code = F.max_by(_reason_code(), F.when(is_terminal(), order_key(order)))
    return events.groupBy(trace).agg(code.alias("_code")).select(
        trace,
        _reason_name(F.col("_code")).alias("stop_reason"),
        F.coalesce(F.col("_code") == 1, F.lit(False)).alias("has_stop"),
    )


def for_all_traces(found: DataFrame, rows: DataFrame, trace: str = "trace") -> DataFrame:
    """`found` (trace, stop_reason, has_stop) with the traces of `rows` that it lacks: no reason, no stop."""
    return rows.select(trace).distinct().join(found, trace, "left").select(
        trace, "stop_reason", F.coalesce("has_stop", F.lit(False)).alias("has_stop"))


def _is_reply() -> Column:
    """Whether an event is a stopping model output of the main agent."""
    return (
        (F.col("agent_role") == fv.MAIN_ROLE)
        & (F.col("event") == fv.MODEL_OUTPUT)
        & (F.col("stop_reason") == fv.TERMINAL_REASONS[0])
    )


def last_reply(
    events: DataFrame, trace: str = "trace", order: Cols = "byte_offset", text: Column | None = None
) -> DataFrame:
    """Text of the last stopping model output that has text items; an empty text counts as none."""
    body = reply_text(F.col("content")) if text is None else text
    # only stopping events reach the aggregate with a text; the rest carry nulls
    rows = events.select(trace, *names(order), F.when(_is_reply(), body).alias("_text"))
    latest = F.max_by("_text", F.when(F.col("_text").isNotNull(), order_key(order)))
    return rows.groupBy(trace).agg(F.nullif(latest, F.lit("")).alias("reply"))


def main_session(
    events: DataFrame, trace: str = "trace", order: Cols = "byte_offset", is_text: str | None = None
) -> DataFrame:
    """First non-blank session id of the main agent, else the first of any agent."""
    return events.groupBy(trace).agg(_main_session(order, is_text).alias("session_id"))


def _main_session(order: Cols, is_text: str | None) -> Column:
    session = strip_ws(F.col("session_id"))
    usable = F.coalesce(session != "", F.lit(False))
    if is_text:
        usable = usable & F.col(is_text)
    rank = F.struct(
        F.when(F.coalesce(F.col("agent_role") == fv.MAIN_ROLE, F.lit(False)), 0).otherwise(1).alias("r"),
        order_key(order).alias("o"),
    )
    return F.min_by(session, F.when(usable, rank))


def trace_summary(
    events: DataFrame, timeout_seconds: int = fv.TASK_TIMEOUT_SECONDS, trace: str = "trace",
    order: Cols = "byte_offset", ts: str = "ts",
) -> DataFrame:
    """Outcome with timeout, latest terminal reason and main session in one pass and one shuffle."""
    terminal = F.when(is_terminal(), order_key(order))
    answers = events.groupBy(trace).agg(
        *_timeout_aggregates(terminal, ts),
        F.max_by(_reason_code(), terminal).alias("_latest"),
        _main_session(order, None).alias("session_id"),
    )
    outcome, ended = _timeout_answer(timeout_seconds)
    return answers.select(
        trace, "started", ended.alias("ended"), outcome.alias("outcome"),
        _reason_name(F.col("_latest")).alias("latest_reason"), "session_id",
    )


def trace_answers(
    events: DataFrame, timeout_seconds: int = fv.TASK_TIMEOUT_SECONDS, trace: str = "trace",
    order: Cols = "byte_offset", ts: str = "ts", is_text: str | None = None,
) -> DataFrame:
    """Outcome with timeout, main session and last reply in one pass and one shuffle."""
    terminal = F.when(is_terminal(), order_key(order))
    rows = events.withColumn("_text", F.when(_is_reply(), reply_text(F.col("content"))))
    latest = F.max_by("_text", F.when(F.col("_text").isNotNull(), order_key(order)))
    answers = rows.groupBy(trace).agg(
        *_timeout_aggregates(terminal, ts), _main_session(order, is_text).alias("session_id"),
        F.nullif(latest, F.lit("")).alias("reply"))
    outcome, _ = _timeout_answer(timeout_seconds)
    return answers.select(trace, outcome.alias("outcome"), "session_id", "reply")


def last_n_per_trace(
    events: DataFrame, n: int, trace: str = "trace", order: Cols = "byte_offset", salts: int = 32
) -> DataFrame:
    """The last `n` rows of every trace.

    Two rounds: the last `n` of each (trace, salt) first, then of each trace. Spark cuts each map
    task's rows to the limit before either shuffle, so a trace that holds a third of all rows
    sends at most `salts * n` rows to one task.
    """
    parts = names(order)
    latest_first = [F.col(c).desc() for c in parts]
    salted = events.withColumn("_salt", F.pmod(F.xxhash64(*parts), F.lit(salts)))
    for keys in ([trace, "_salt"], [trace]):
        window = Window.partitionBy(*keys).orderBy(*latest_first)
        salted = salted.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
    return salted.drop("_salt")


def stop_count_last_n(
    events: DataFrame, n: int = fv.STOP_COUNT_MODEL_OUTPUTS, trace: str = "trace", order: Cols = "byte_offset"
) -> DataFrame:
    """Stopping events of the main agent among the last `n` model outputs of all agents."""
    outputs = events.where(F.col("event") == fv.MODEL_OUTPUT).select(
        trace, *names(order), "agent_role", "stop_reason"
    )
    stop = (F.col("agent_role") == fv.MAIN_ROLE) & (F.col("stop_reason") == fv.TERMINAL_REASONS[0])
    counts = last_n_per_trace(outputs, n, trace, order).groupBy(trace).agg(
        F.count_if(F.coalesce(stop, F.lit(False))).alias("n_stop")
    )
    traces = events.select(trace).distinct()
    return traces.join(counts, trace, "left").select(trace, F.coalesce("n_stop", F.lit(0)).alias("n_stop"))


def recent_terminal(
    events: DataFrame, n: int = fv.RECENT_MODEL_OUTPUTS, trace: str = "trace", order: Cols = "byte_offset"
) -> DataFrame:
    """`latest_terminal` seen through the last `n` model outputs only, as a poll sees it.

    A trace without model outputs has no reason.
    """
    outputs = events.where(F.col("event") == fv.MODEL_OUTPUT)
    found = latest_terminal(last_n_per_trace(outputs, n, trace, order), trace, order)
    return for_all_traces(found, events, trace)


def created_time(
    lines: DataFrame, mtimes: DataFrame | None = None, trace: str = "trace", order: Cols = "byte_offset",
    timestamp: str = "timestamp",
) -> DataFrame:
    """Timestamp of the first line, which counts even when malformed, else the file's mtime."""
    first = lines.groupBy(trace).agg(F.min_by(timestamp, order_key(order)).alias("_ts"))
    created = iso_timestamp(F.col("_ts"))
    if mtimes is None:
        return first.select(trace, created.alias("created"))
    return first.join(mtimes.select(trace, "mtime"), trace, "left").select(
        trace, F.coalesce(created, F.timestamp_seconds("mtime")).alias("created")
    )


def since_baseline(
    events: DataFrame, baseline: DataFrame, trace: str = "trace", offset: str = "byte_offset",
    base: str = "base_size",
) -> DataFrame:
    """Events at or after the baseline offset of their trace; traces not in the baseline are new."""
    return (
        join_spread(events, baseline.select(trace, base), trace, by=offset, how="left")
        .where(F.col(offset) >= F.coalesce(F.col(base), F.lit(0)))
        .drop(base)
    )


def outcome_with_timeout(
    events: DataFrame, timeout_seconds: int = fv.TASK_TIMEOUT_SECONDS, trace: str = "trace",
    order: Cols = "byte_offset", ts: str = "ts",
) -> DataFrame:
    """Outcome a watcher would report: the first terminal event within the timeout, else timeout.

    The clock starts at the trace's earliest event; a terminal event without a time is in time and counts
    as of the start. `ts` may have or lack a time zone.
    """
    terminal = F.when(is_terminal(), order_key(order))
    outcome, ended = _timeout_answer(timeout_seconds)
    return events.groupBy(trace).agg(*_timeout_aggregates(terminal, ts)).select(
        trace, "started", outcome.alias("outcome"), ended.alias("ended")
    )


def _timeout_aggregates(terminal: Column, ts: str) -> list[Column]:
    return [
        F.min(ts).alias("started"),
        F.min_by(_reason_code(), terminal).alias("_code"),
        F.min_by(F.col(ts), terminal).alias("_at"),
    ]


def _timeout_answer(timeout_seconds: int) -> tuple[Column, Column]:
    limit = F.expr(f"INTERVAL {int(timeout_seconds)} SECONDS")
    ended = F.col("_code").isNotNull()
    in_time = ended & F.coalesce(F.col("_at") < F.col("started") + limit, F.lit(True))
    outcome = F.when(in_time, _reason_name(F.col("_code"))).otherwise("timeout")
    return outcome, F.when(in_time, F.coalesce("_at", "started")).otherwise(F.col("started") + limit)
