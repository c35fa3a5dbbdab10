"""Run outcomes: deliverables, failure kinds, attempts, markers, batch roll-up and hand-off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.ids import natural_key
from runlens.functions.text import path_format, requested_formats
from runlens.operators.common import Cols, names, order_key
from runlens.operators.ordinals import with_ordinal


# --- deliverables -------------------------------------------------------------------------------

def present_formats(artifacts: DataFrame, case: str = "case_id", path: str = "path") -> DataFrame:
    """Sorted distinct normalised extensions of the files of each case."""
    formats = F.collect_set(path_format(F.col(path)))
    return artifacts.groupBy(case).agg(F.array_sort(formats).alias("present_formats"))


def missing_formats(required: Column, present: Column) -> Column:
    """Sorted required formats that are not present."""
    return F.array_sort(F.array_except(required, F.coalesce(present, F.array().cast("array<string>"))))


def all_present(required: Column, present: Column) -> Column:
    return F.size(missing_formats(required, present)) == 0


def missing_format_rows(required: DataFrame, present: DataFrame, case: str = "case_id") -> DataFrame:
    """The same as rows (case, format): an anti join, for sets too large for arrays."""
    return required.select(case, "format").distinct().join(
        present.select(case, "format").distinct(), [case, "format"], "left_anti"
    )


def pull_counts(artifacts: DataFrame, case: str = "case_id") -> DataFrame:
    """Files pulled per case and source."""
    pulled = lambda source: F.count_if(
        (F.col("source") == source) & F.coalesce(F.col("status") == "pulled", F.lit(False))
    )
    return artifacts.groupBy(case).agg(
        pulled("report").alias("outputs_pulled"),
        pulled("worklog").alias("worklogs_pulled"),
        pulled("summary").alias("summaries_pulled"),
    )


# --- outcome ------------------------------------------------------------------------------------

def run_outcome(
    prep_failed: Column, interrupted: Column, timed_out: Column, agent_error: Column, missing: Column,
    other_error: Column,
) -> tuple[Column, Column]:
    """(outcome, failure kind) of a run. The reply's verdict plays no part.

    A failed preparation ends the attempt before the run. An interruption hides every failure.
    Otherwise the first that applies of timeout, agent error, missing deliverables, other error.
    """
    t = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(t(prep_failed), "data-preparation")
        .when(t(interrupted), F.lit(None).cast("string"))
        .when(t(timed_out), "timeout")
        .when(t(agent_error), "agent-error")
        .when(t(missing), "missing-deliverables")
        .when(t(other_error), "execution-error")
    )
    outcome = (
        F.when(t(prep_failed), "failed")
        .when(t(interrupted), "interrupted")
        .when(kind.isNotNull(), "failed")
        .otherwise("complete")
    )
    return outcome, kind


def failure_distribution(runs: DataFrame, by: Cols = ()) -> DataFrame:
    """Runs per outcome and failure kind."""
    return runs.groupBy(*names(by), "outcome", "failure_kind").agg(F.count(F.lit(1)).alias("n_runs"))


def run_results(
    tasks: DataFrame, trace_answers: DataFrame, artifacts: DataFrame, verdict: Column, case: str = "case_id",
) -> DataFrame:
    """One result record per task: formats, pull counts, verdict, session, outcome.

    `tasks`: case, person, task. `trace_answers`: case, outcome (stop, error or timeout), reply,
    session_id. `artifacts`: case, source, path, status. Both sides are aggregated to one row per
    case before the join, so the joins see small, unique keys. `verdict` is a column over `reply`.
    `tasks` may have the booleans `preparation_failed` (there was no run: no session, no verdict) and
    `interrupted`; without them no run counts as either.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)) if c in tasks.columns else F.lit(False) for c in ("preparation_failed", "interrupted")]
    prep_failed, interrupted = flags
    pulled_report = (F.col("source") == "report") & F.coalesce(F.col("status") == "pulled", F.lit(False))
    formats = F.collect_set(F.when(pulled_report, path_format(F.col("path"))))
    per_case = artifacts.groupBy(case).agg(
        F.array_sort(formats).alias("present_formats"),
        *[
            F.count_if((F.col("source") == s) & (F.col("status") == "pulled")).alias(c)
            for s, c in (("report", "outputs_pulled"), ("worklog", "worklogs_pulled"), ("summary", "summaries_pulled"))
        ],
    )
    none = F.array().cast("array<string>")
    joined = (
        tasks.withColumn("required_formats", requested_formats(F.col("task")))
        .withColumns({"_prep_failed": prep_failed, "_interrupted": interrupted})
        .join(trace_answers.withColumnRenamed("outcome", "trace_outcome"), case, "left")
        .join(per_case, case, "left")
        .withColumn("present_formats", F.coalesce("present_formats", none))
        .withColumn("missing_formats", missing_formats(F.col("required_formats"), F.col("present_formats")))
    )
    no_session = F.col("_prep_failed") | (F.coalesce(F.col("session_id"), F.lit("")) == "")
    ended = F.when(F.col("_prep_failed"), "not-run").otherwise(F.coalesce(F.col("trace_outcome"), F.lit("timeout")))
    outcome, kind = run_outcome(
        F.col("_prep_failed"), F.col("_interrupted"), ended == "timeout", ended == "error", F.size("missing_formats") > 0, no_session
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        case, "person", "required_formats", "present_formats", "missing_formats",
        zero("outputs_pulled"), zero("worklogs_pulled"), zero("summaries_pulled"),
        F.when(ended == "stop", verdict).otherwise("not-started").alias("dialog_verdict"),
        F.when(~no_session, F.col("session_id")).alias("session_id"),
        F.when(no_session & (ended == "stop"), F.array(F.lit("missing-session-id"))).otherwise(none).alias("warnings"),
        outcome.alias("outcome"), kind.alias("failure_kind"),
    )


# --- attempts and markers -------------------------------------------------------------------------

def attempts(ledger: DataFrame, case: str = "case_id", order: Cols = "attempt") -> DataFrame:
    """Attempt history per case: first and final outcome, and whether the retry rule was kept.

    A second attempt is due only after a timeout or an agent error. All columns are mergeable
    aggregates, so a case with very many attempts never has to sit in one window.
    """
    key = order_key(order)
    per_case = ledger.groupBy(case).agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.min_by(F.struct("marker", "failure_kind"), key).alias("_first"),
        F.max_by(F.struct("marker", "failure_kind"), key).alias("_final"),
    )
    eligible = F.coalesce(
        (F.col("_first.marker") == "failed") & F.col("_first.failure_kind").isin(*fv.RETRYABLE_FAILURES), F.lit(False)
    )
    retried = F.col("n_attempts") > 1
    return per_case.select(
        case, "n_attempts",
        F.col("_first.failure_kind").alias("first_failure_kind"),
        F.col("_final.marker").alias("final_marker"),
        F.col("_final.failure_kind").alias("final_failure_kind"),
        eligible.alias("retry_eligible"),
        (eligible & retried & (F.col("_final.marker") == "complete")).alias("retry_recovered"),
        ((F.col("n_attempts") > fv.MAX_ATTEMPTS) | (retried & ~eligible)).alias("policy_violation"),
    )


def current_attempts(ledger: DataFrame, case: str = "case_id", attempt: str = "attempt") -> DataFrame:
    """Ledger rows of the latest attempt of each case; earlier attempts are history."""
    latest = ledger.groupBy(case).agg(F.max(attempt).alias(attempt))
    return ledger.join(latest, [case, attempt], "left_semi")


def task_status(tasks: DataFrame, ledger: DataFrame, case: str = "case_id", attempt: str = "attempt") -> DataFrame:
    """Execution outcome per task from the markers of its latest attempt.

    Interrupted beats failed, failed beats complete; a task without markers was not run.
    """
    rank = F.lit(None).cast("int")
    for i, marker in enumerate(fv.MARKER_PRECEDENCE):
        rank = F.when(F.col("marker") == marker, len(fv.MARKER_PRECEDENCE) - i).otherwise(rank)
    best = F.max(F.when(rank.isNotNull(), F.struct(F.col(attempt).alias("a"), rank.alias("r")))).alias("_m")
    markers = ledger.groupBy(case).agg(best)
    name = F.lit("not-run")
    for i, marker in enumerate(fv.MARKER_PRECEDENCE):
        name = F.when(F.col("_m.r") == len(fv.MARKER_PRECEDENCE) - i, marker).otherwise(name)
    return tasks.join(markers, case, "left").select(*tasks.columns, name.alias("execution_outcome"))


def stop_on_error(
    results: DataFrame, group: str = "person", order: Cols = "task_no", failed: str = "failed",
    group_order: Cols | None = None, batch: Cols = (),
) -> DataFrame:
    """Adds `executed`: whether a batch that stops at its first failure would reach the row.

    Inside a group everything up to its first failed row runs; groups after the first group with a
    failure do not run at all. `batch` names the columns of a batch; without any, all rows are one. Groups
    stand in the order of `group_order`, which must be constant inside a group, by default in the natural
    order of their first id (the last column of `order`). The first failures are minimums, joined back, so
    neither a window nor a global sort is needed.
    """
    position, keys = order_key(order), names(batch)
    rows = results
    if group_order is None:
        first_id = results.groupBy(*keys, group).agg(
            F.min(natural_key(F.col(names(order)[-1]).cast("string"))).alias("_id"))
        rows = rows.join(first_id.withColumn("_place", F.struct("_id", group)).drop("_id"), [*keys, group])
    else:
        rows = rows.withColumn("_place", order_key(group_order))
    first = rows.where(F.col(failed)).groupBy(*keys, group).agg(
        F.min(position).alias("_first_failed"), F.min("_place").alias("_group_place"))
    in_group = F.col("_first_failed").isNull() | (position <= F.col("_first_failed"))
    reached = rows.join(first.drop("_group_place"), [*keys, group], "left")
    if keys:
        stop = first.groupBy(*keys).agg(F.min("_group_place").alias("_stop"))
        reached, stop_at = reached.join(stop, keys, "left"), F.col("_stop")
    else:
        stop_at = first.agg(F.min("_group_place").alias("_stop")).scalar()
    in_batch = F.coalesce(F.col("_place") <= stop_at, F.lit(True))
    return reached.withColumn("executed", in_group & in_batch).select(*results.columns, "executed")


# --- batches ----------------------------------------------------------------------------------------

def entry_ready() -> Column:
    """Whether one hand-off entry is settled and, when complete, has all its inputs."""
    inputs = F.lit(True)
    for c in ("has_metadata", "has_outputs", "has_run_dir", "has_trace", "has_marker"):
        inputs = inputs & F.coalesce(F.col(c), F.lit(False))
    done = F.col("execution_outcome")
    return F.coalesce(done.isin(*fv.MARKER_PRECEDENCE) & ((done != "complete") | inputs), F.lit(False))


def batch_ready(batches: DataFrame, entries: DataFrame, run: str = "run_id") -> DataFrame:
    """`runner_finished` per batch: it says so itself and all its entries are ready; an empty batch is."""
    ready = entries.groupBy(run).agg(F.bool_and(entry_ready()).alias("_ready"), F.count(F.lit(1)).alias("n_tasks"))
    finished = F.col("finished") if "finished" in batches.columns else F.lit(True)
    return batches.join(ready, run, "left").select(
        run, F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"),
        (finished & F.coalesce("_ready", F.lit(True))).alias("runner_finished"),
    )


def batch_rollup(runs: DataFrame, run: str = "run_id", person: str = "person") -> DataFrame:
    """Successes and failures per person, per batch and overall; `ok` when nothing failed."""
    return runs.rollup(run, person).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count_if("ok_run").alias("n_success"),
        F.count_if(~F.col("ok_run")).alias("n_failed"),
    ).withColumn("ok", F.col("n_failed") == 0)


def meta_merge(updates: DataFrame, case: str = "case_id", order: Cols = "seq") -> DataFrame:
    """Latest value of every field per case, as rows (case, field, value, order).

    A row means that the field was set, even to null; a field never set has no row. The result has the
    shape of its input, so it can be merged again with later updates, and free fields are kept.
    """
    latest = F.max_by(F.struct("value", *names(order)), order_key(order)).alias("_last")
    return updates.groupBy(case, "field").agg(latest).select(
        case, "field", "_last.value", *[f"_last.{c}" for c in names(order)])


def meta_wide(merged: DataFrame, fields: Sequence[str], case: str = "case_id") -> DataFrame:
    """One row per case with a column per named field; null when it was never set or set to null."""
    return merged.groupBy(case).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


SECTIONS = {"report": "outputs", "worklog": "worklogs", "summary": "summaries"}


def manifest(artifacts: DataFrame, case: str = "case_id", path: str = "path") -> DataFrame:
    """Records of the cases' manifests: a row per artifact with its section and its place in natural order.

    The layout is the same for a case of any size: a document is its header (`manifest_headers`) and the rows
    of its key by (section, sort_key). Records without a known source belong to no section and are left out.
    """
    section = F.lit(None).cast("string")
    for source, name in SECTIONS.items():
        section = F.when(F.col("source") == source, name).otherwise(section)
    rest = [c for c in artifacts.columns if c not in (case, "source")]
    return artifacts.select(case, section.alias("section"), natural_key(F.col(path)).alias("sort_key"), *rest).where(
        "section is not null")


def manifest_headers(
    cases: DataFrame, artifacts: DataFrame, workspace_root: str = fv.WORKSPACE_ROOT
) -> DataFrame:
    """Manifest headers with the number of records per section; a case without artifacts has zeros.

    `cases`: case_id, task_id, session_id, pulled_at, and optionally selection_source.
    """
    root = workspace_root.rstrip("/") + "/"
    counts = artifacts.groupBy("case_id").agg(
        *[F.count_if(F.col("source") == source).alias(f"n_{name}") for source, name in SECTIONS.items()])
    selection = [c for c in ("selection_source",) if c in cases.columns]
    return cases.join(counts, "case_id", "left").select(
        "task_id", "case_id", "pulled_at", "session_id", *selection,
        F.struct(
            F.concat(F.lit(root), "session_id").alias("session_root"),
            F.lit(root + fv.WORKLOG_RELATIVE_ROOT).alias("worklog_root"),
            F.lit(root + fv.SUMMARY_RELATIVE_ROOT).alias("summary_root"),
        ).alias("workspace"),
        *[F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in SECTIONS.values()],
    )


def folder_manifest(pulled: DataFrame, roots: dict[str, str], case: str = "case_id") -> DataFrame:
    """Records of files pulled from fixed root folders, each under its folder's name, in natural order.

    `roots`: folder name -> remote path, a configuration value. Files elsewhere are left out.
    """
    file_name = F.substring_index("remote_path", "/", -1)
    parent = F.substring("remote_path", F.lit(1), F.length("remote_path") - F.length(file_name) - 1)
    folder = F.lit(None).cast("string")
    for name, root in roots.items():
        folder = F.when(parent == root.rstrip("/"), name).otherwise(folder)
    local = F.when(F.col("status") == "pulled", F.concat(F.lit("outputs/"), "folder", F.lit("/"), file_name))
    rest = [c for c in pulled.columns if c != case]
    return pulled.withColumn("folder", folder).where(F.col("folder").isNotNull()).select(
        case, "folder", natural_key(F.col("remote_path")).alias("sort_key"), *rest, local.alias("local_path"))


HANDOFF_ROOTS = ("metadata", "deliverables", "logs", "taskArtifacts")


def handoff(
    batches: DataFrame, entries: DataFrame, run: str = "run_id", roots: dict[str, str] | None = None,
    adapter: str = fv.TASK_ADAPTER,
) -> tuple[DataFrame, DataFrame]:
    """Batch hand-offs: (a header per batch, a row per task entry with its place in natural order as a number, `ordinal`).

    `entries`: run, task_id, person, execution_outcome, metadata, trace, outputs, marker,
    run_dir and the `has_*` flags of `batch_ready`.
    """
    rows = entries.select(
        F.col(run).alias("runId"),
        natural_key(F.col("task_id")).alias("sort_key"),
        F.col("task_id").alias("taskId"),
        "person",
        F.col("execution_outcome").alias("executionOutcome"),
        "metadata",
        F.when(F.col("has_trace"), F.col("trace")).alias("trace"),
        "outputs",
        F.when(F.col("has_marker"), F.col("marker")).alias("marker"),
        F.struct(
            "metadata", F.lit(None).cast("string").alias("data"), "outputs", F.col("run_dir").alias("runnerTaskDir")
        ).alias("judgeInputs"),
    )
    rows = with_ordinal(rows, ["sort_key", "person", "taskId"], ["runId"])
    places = [F.lit((roots or {}).get(r)).cast("string").alias(r) for r in HANDOFF_ROOTS]
    headers = batch_ready(batches, entries, run).select(
        F.lit(fv.HANDOFF_VERSION).alias("version"),
        F.lit(adapter).alias("adapter"),
        F.col(run).alias("runId"),
        F.col("runner_finished").alias("runnerFinished"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("writtenAt"),
        F.struct(*places).alias("roots"),
        F.col("n_tasks").alias("nTasks"),
    )
    return headers, rows
