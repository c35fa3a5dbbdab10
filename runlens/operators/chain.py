"""From raw traces and listings to results, task status and batch totals, in one chain of set-wise jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import iso_timestamp
from runlens.operators import listings, runs, traces
from runlens.session import durable
from runlens.sources.traces import parse_events


def results(
    tasks: DataFrame, lines: DataFrame, listing: DataFrame, verdict: Column, timeout_seconds: int = fv.TASK_TIMEOUT_SECONDS,
    workspace_root: str = fv.WORKSPACE_ROOT, case: str = "case_id",
) -> DataFrame:
    """One result record per task (see `run_results`), from what its run left behind.

    `lines`: case, byte_offset and a raw JSONL line; a case is a trace. `listing`: case, path, size and status of the
    files on the device of a case. Every line is parsed once, and one aggregate answers for a trace. The session found there
    decides which reports count; without a session no file of the case does. The answers, one row per case, are written before they
    meet listing and tasks, so that the lines are not read again for each.
    """
    events = parse_events(lines).withColumn("ts", iso_timestamp(F.col("timestamp")))
    answers = durable(traces.trace_answers(events, timeout_seconds, trace=case, is_text="session_is_text"))
    sessions = answers.where(F.col("session_id").isNotNull()).select(case, "session_id")
    files, _ = listings.session_artifacts(listing, sessions, case, workspace_root)
    own = files.join(sessions.select(case), case, "left_semi")
    return runs.run_results(tasks, answers, own, verdict, case)


def status(tasks: DataFrame, earlier: DataFrame, found: DataFrame, attempt: int, case: str = "case_id") -> DataFrame:
    """Tasks with `execution_outcome` after this attempt, and what its hand-off entry holds.

    `earlier`: case, attempt, marker of attempts before. A task that did not run this time keeps its earlier outcome.
    """
    found = durable(found.select(case, "outcome", "outputs_pulled", "session_id"))
    markers = found.select(case, F.lit(attempt).alias("attempt"), F.col("outcome").alias("marker"))
    every = runs.task_status(tasks, earlier.select(case, "attempt", "marker").unionByName(markers), case)
    held = found.select(
        case, F.lit(True).alias("has_run_dir"), (F.col("outputs_pulled") > 0).alias("has_outputs"),
        F.col("session_id").isNotNull().alias("has_trace"))
    return every.join(held, case, "left").withColumns({
        "has_metadata": F.lit(True), "has_marker": F.col("execution_outcome") != "not-run"})


def totals(batches: DataFrame, entries: DataFrame, run: str = "run_id", person: str = "person") -> DataFrame:
    """Successes and failures per person, batch and overall; a batch's rows also say whether it is finished."""
    counted = entries.withColumn("ok_run", F.col("execution_outcome") == "complete")
    ready = runs.batch_ready(batches, entries, run).select(run, "runner_finished")
    return runs.batch_rollup(counted, run, person).join(ready, run, "left")
