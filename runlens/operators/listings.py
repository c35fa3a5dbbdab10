"""Snapshots of file listings: what changed, which log is active, when a listing became stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import let, path_format
from runlens.operators.common import Cols, names


def snapshot_diff(current: DataFrame, before: DataFrame, path: str = "path") -> DataFrame:
    """Every file of the current listing with its change kind: new, grew, touched or same.

    A file that vanished is not reported; one that shrank counts only when its mtime advanced.
    """
    old = before.select(path, F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("_known"))
    kind = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("size") > F.col("old_size"), "grew")
        .when(F.col("mtime") > F.col("old_mtime"), "touched")
        .otherwise("same")
    )
    return current.join(old, path, "left").withColumn("change_kind", kind).drop("_known")


def changed_files(current: DataFrame, before: DataFrame, path: str = "path") -> DataFrame:
    """New, grown or touched files, most recently changed first."""
    changed = snapshot_diff(current, before, path).where(F.col("change_kind") != "same")
    return changed.orderBy(F.desc("mtime"), F.desc("size"), F.desc(path))


def active_log(changed: DataFrame, keys: Cols, path: str = "path") -> DataFrame:
    """Most recently changed file per key: the log to watch."""
    newest = F.max(F.struct("mtime", "size", path)).alias("_m")
    return changed.groupBy(*names(keys)).agg(newest).select(
        *names(keys), F.col(f"_m.{path}").alias(path), "_m.size", "_m.mtime"
    )


def new_main_log(
    current: DataFrame, before: DataFrame, keys: Cols, path: str = "path", name: str = "name",
    created: str = "created",
) -> DataFrame:
    """Among files not in the baseline: longest name, then earliest creation, then path."""
    fresh = current.join(before.select(path), path, "left_anti")
    best = F.min(F.struct((-F.length(name)).alias("len"), created, path)).alias("_b")
    return fresh.groupBy(*names(keys)).agg(best).select(*names(keys), f"_b.{path}", f"_b.{created}")


def watched_log(
    current: DataFrame, before: DataFrame, keys: Cols, path: str = "path", name: str = "name",
    created: str = "created",
) -> DataFrame:
    """The main new log per key, or the most recently changed old log where nothing is new."""
    changed = snapshot_diff(current, before, path).where(F.col("change_kind") != "same")
    new = F.col("change_kind") == "new"
    main = F.min(F.when(new, F.struct((-F.length(name)).alias("len"), created, path))).alias("_new")
    active = F.max(F.struct("mtime", "size", path)).alias("_active")
    return changed.groupBy(*names(keys)).agg(main, active).select(
        *names(keys),
        F.coalesce(F.col(f"_new.{path}"), F.col(f"_active.{path}")).alias(path),
        F.when(F.col("_new").isNotNull(), "new").otherwise("changed").alias("origin"),
    )


def listing_signature(listing: DataFrame, keys: Cols, fields: Cols = ("path", "size", "mtime")) -> DataFrame:
    """Fingerprint of a set of files per key, equal exactly when the files are (up to hashing).

    Sums of two 64-bit row hashes do not depend on row order, so the aggregate needs no sorting and
    no collected list; the row count is part of the fingerprint.
    """
    return listing.groupBy(*names(keys)).agg(*signature_aggregates(fields))


def signature_aggregates(fields: Cols) -> list[Column]:
    """Count and fingerprint columns. 31-bit pieces keep the sums inside a long for 4 billion rows."""
    columns = [F.col(c) for c in names(fields)]
    pieces = [
        F.sum(F.shiftrightunsigned(row, shift).bitwiseAND(F.lit(0x7FFFFFFF)))
        for row in (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)) for shift in (0, 33)
    ]
    signature = F.concat_ws("-", *[p.cast("string") for p in pieces])
    return [F.count(F.lit(1)).alias("n_files"), signature.alias("signature")]


def poll_states(
    polls: DataFrame, files: DataFrame, required: DataFrame | None = None, require_worklog: bool = False,
    session: str = "session_id", poll: str = "poll_no",
) -> DataFrame:
    """Per poll: fingerprint of all listed files, and whether the required ones are there.

    `files` has session, poll, source, path, size, mtime; `required` a format array per session.
    Without required formats any report will do. Polls that listed nothing are kept.
    """
    keys = [session, poll]
    is_report = F.col("source") == "report"
    seen = files.groupBy(*keys).agg(
        *signature_aggregates(("source", "path", "size", "mtime")),
        F.collect_set(F.when(is_report, path_format(F.col("path")))).alias("_formats"),
        F.coalesce(F.bool_or(F.col("source") == "worklog"), F.lit(False)).alias("_worklog"),
    )
    state = polls.select(*keys).distinct().join(seen, keys, "left")
    if required is None:
        state = state.withColumn("_required", F.array().cast("array<string>"))
    else:
        state = state.join(required.select(session, F.col("required").alias("_required")), session, "left")
    formats = F.coalesce("_formats", F.array().cast("array<string>"))
    wanted = F.coalesce("_required", F.array().cast("array<string>"))
    enough = F.when(F.size(wanted) > 0, F.size(F.array_except(wanted, formats)) == 0).otherwise(F.size(formats) > 0)
    worklog = F.coalesce("_worklog", F.lit(False)) if require_worklog else F.lit(True)
    return state.select(
        *keys, F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("signature", F.lit("")).alias("signature"),
        (enough & worklog).alias("present"),
    )


def stability_runs(
    polls: DataFrame, session: str = "session_id", poll: str = "poll_no", signature: str = "signature",
    present: str = "present", bucket_polls: int = 4096,
) -> DataFrame:
    """Adds `run`: how many polls in a row have shown the same listing with the required files.

    A poll without the required files has run 0; a changed listing starts again at 1. A session's
    polls are cut into buckets of consecutive poll numbers. Windows run inside a bucket, and the
    bucket totals (one row per bucket) carry a run across bucket borders, so even a session with a
    third of all polls is spread over many tasks. A poll without a session or number has no place in a
    sequence: it keeps its row, with run 0, and breaks no run.
    """
    state = F.struct(F.col(signature).alias("s"), F.coalesce(F.col(present), F.lit(False)).alias("p"))
    rest = [c for c in polls.columns if c not in (session, poll, signature, present)]
    # both uses of `rows` below need the same columns and filter, so Spark shuffles them once
    rows = polls.select(
        session, poll, *rest, F.floor(F.col(poll) / bucket_polls).cast("bigint").alias("_b"), state.alias("_state")
    ).where(F.col(session).isNotNull() & F.col("_b").isNotNull())
    in_bucket = Window.partitionBy(session, "_b").orderBy(poll)
    rows = (
        rows.withColumn("_prev", F.lag("_state").over(in_bucket))
        .withColumn("_rn", F.row_number().over(in_bucket))
        .withColumn("_break", F.col("_prev").isNotNull() & ~_continues(F.col("_prev"), F.col("_state")))
        .withColumn("_last_break", F.max(F.when(F.col("_break"), F.col("_rn"))).over(
            in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    by_bucket = Window.partitionBy(session).orderBy("_b")
    buckets = (
        rows.groupBy(session, "_b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("_state", "_rn").alias("first"),
            F.max_by("_state", "_rn").alias("last"),
            F.max("_last_break").alias("inner_break"),
        )
        .withColumn("before", F.lag("last").over(by_bucket))
        .withColumn("first_breaks", F.coalesce(~_continues(F.col("before"), F.col("first")), F.lit(True)))
        .withColumn("break_at", F.coalesce("inner_break", F.when(F.col("first_breaks"), F.lit(1))))
        .withColumn("tail", F.when(F.col("break_at").isNotNull(), F.col("n") - F.col("break_at") + 1).otherwise(F.col("n")))
        .withColumn("stretch", F.sum(F.when(F.col("break_at").isNotNull(), 1).otherwise(0)).over(
            by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("carried_out", F.sum("tail").over(
            Window.partitionBy(session, "stretch").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_carry", F.when(F.col("first_breaks"), F.lit(0)).otherwise(
            F.coalesce(F.lag("carried_out").over(by_bucket), F.lit(0))))
        .select(session, "_b", "_carry")
    )
    run = (
        F.when(~F.col("_state.p"), F.lit(0))
        .when(F.col("_last_break").isNotNull(), F.col("_rn") - F.col("_last_break") + 1)
        .otherwise(F.col("_rn") + F.col("_carry"))
    )
    joined = rows.join(buckets, [session, "_b"])
    shown = {signature: F.col("_state.s").alias(signature), present: F.col("_state.p").alias(present)}
    placed = joined.select(*[shown.get(c, F.col(c)) for c in polls.columns], run.cast("bigint").alias("run"))
    loose = polls.where(F.col(session).isNull() | F.col(poll).isNull())
    return placed.unionAll(loose.select(
        *[F.coalesce(c, F.lit(False)).alias(c) if c == present else F.col(c) for c in polls.columns], F.lit(0).cast("bigint").alias("run")))


def _continues(before: Column, now: Column) -> Column:
    """A run goes on when both polls have the required files and the listing is the same."""
    return before["p"] & now["p"] & before["s"].eqNullSafe(now["s"])


def first_stable_poll(
    runs: DataFrame, checks: int = fv.STABLE_CHECKS, session: str = "session_id", poll: str = "poll_no"
) -> DataFrame:
    """Poll whose listing is taken: the first stable one, else the last one seen.

    Polls without a session are nobody's; a session whose polls have no number has a null poll.
    """
    needed = max(1, checks)
    return runs.where(F.col(session).isNotNull()).groupBy(session).agg(
        F.min(F.when(F.col("run") >= needed, F.col(poll))).alias("_stable"), F.max(poll).alias("_last")
    ).select(
        session,
        F.coalesce("_stable", "_last").alias(poll),
        F.col("_stable").isNotNull().alias("stable"),
    )


def union_sources(reports: DataFrame, worklogs: DataFrame, summaries: DataFrame) -> DataFrame:
    """One set of artifact rows with the source each came from."""
    tagged = lambda df, tag: df.withColumn("source", F.lit(tag))
    return (
        tagged(reports, "report")
        .unionByName(tagged(worklogs, "worklog"))
        .unionByName(tagged(summaries, "summary"))
    )


def session_artifacts(
    listing: DataFrame, sessions: DataFrame, owner: str, workspace_root: str = fv.WORKSPACE_ROOT,
    path: str = "path", session: str = "session_id",
) -> tuple[DataFrame, DataFrame]:
    """(artifact rows, per-session counts) of the given sessions.

    Reports are the files directly in a session's directory, found by an equi join on the session
    id in the path. Work logs and summaries live at workspace level and are shared by all sessions
    of an owner (the device or user whose workspace it is): they are kept once, with a null session,
    and joined to sessions only as counts. Pairing every session with every shared file would square
    the data and add nothing.
    """
    root = workspace_root.rstrip("/") + "/"

    def place(below: Column) -> Column:
        shared_under = lambda rel: F.startswith(below, F.lit(rel + "/"))
        return let(F.split(below, "/"), lambda parts: F.struct(
            F.when(shared_under(fv.WORKLOG_RELATIVE_ROOT), "worklog").when(shared_under(fv.SUMMARY_RELATIVE_ROOT), "summary")
            .when(F.size(parts) == 2, "report").alias("source"),
            F.get(parts, F.lit(0)).alias("first")))

    # in a generator, so that what is asked of the source later does not repeat the path and its tests
    inside = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1), F.length(path)))
    placed = listing.select("*", F.explode_outer(F.array(let(inside, place))).alias("_place"))
    tagged = placed.withColumn("source", F.col("_place.source")).where(F.col("source").isNotNull())
    wanted = sessions.select(session, owner).distinct()
    reports = tagged.where(F.col("source") == "report").withColumn(session, F.col("_place.first")).drop("_place")
    reports = reports.join(wanted, [owner, session], "left_semi")
    shared = tagged.where(F.col("source") != "report").withColumn(session, F.lit(None).cast("string")).drop("_place")
    rows = reports.unionByName(shared)

    report_counts = reports.groupBy(owner, session).agg(
        F.count(F.lit(1)).alias("n_reports"),
        F.array_sort(F.collect_set(path_format(F.col(path)))).alias("report_formats"),
    )
    shared_counts = shared.groupBy(owner).agg(
        F.count_if(F.col("source") == "worklog").alias("n_worklogs"),
        F.count_if(F.col("source") == "summary").alias("n_summaries"),
    )
    counts = wanted.join(report_counts, [owner, session], "left").join(shared_counts, owner, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows, counts.select(
        owner, session, zero("n_reports"),
        F.coalesce("report_formats", F.array().cast("array<string>")).alias("report_formats"),
        zero("n_worklogs"), zero("n_summaries"),
    )
