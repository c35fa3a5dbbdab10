"""Task registry: validation, order, selection, target codes, batch versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.ids import id_problem, natural_key, safe_id
from runlens.functions.text import is_blank, run_mmdd, strip_ws, target_items
from runlens.operators.common import Cols, exploded, join_spread, names
from runlens.operators.ordinals import with_ordinal


def normalize_targets(values: DataFrame, list_id: Cols, pos: str = "pos", value: str = "value") -> DataFrame:
    """Distinct codes of each list with the place where each first occurs, as (pos, item_pos)."""
    items = exploded(values, [*names(list_id), pos], target_items(F.col(value)), "code", "item_pos")
    first = F.min(F.struct(pos, "item_pos")).alias("_f")
    return items.groupBy(*names(list_id), "code").agg(first).select(
        *names(list_id), "code", f"_f.{pos}", "_f.item_pos"
    )


def registry_report(tasks: DataFrame, adapter: str = fv.TASK_ADAPTER) -> DataFrame:
    """(path, violation): every rule a registry row breaks, not only the first.

    A row whose id is used by another row, regardless of case, is a duplicate. A row that could not be read (`problem`)
    has that violation only.
    """
    unread = None
    if "problem" in tasks.columns:
        unread = tasks.where(F.col("problem").isNotNull()).select("path", F.col("problem").alias("violation"))
        tasks = tasks.where(F.col("problem").isNull())
    id_type = F.col("absolute_id_type") if "absolute_id_type" in tasks.columns else None
    unsafe = id_problem(F.col("absolute_id"), id_type)
    rule = lambda broken, label: F.when(F.coalesce(broken, F.lit(True)), F.lit(label))
    blank_task = is_blank(F.col("task"))
    if "task_type" in tasks.columns:
        blank_task = blank_task | F.coalesce(F.col("task_type") != "STRING", F.lit(True))
    violations = F.array(
        rule(F.col("adapter") != adapter, "adapter"),
        rule(F.col("person") != F.col("dir_person"), "person-directory"),
        rule(F.col("absolute_id") != F.col("dir_id"), "id-directory"),
        F.when(unsafe.isNotNull(), F.concat(F.lit("id-"), unsafe)),
        rule(blank_task, "blank-task"),
    )
    single = exploded(tasks, ["path"], violations, "violation")
    duplicates = duplicate_ids(tasks).select("path", F.lit("duplicate-id").alias("violation"))
    found = single.unionByName(duplicates)
    return found if unread is None else found.unionByName(unread)


def duplicate_ids(tasks: DataFrame, task_id: str = "absolute_id") -> DataFrame:
    """Rows that share their id, compared without case, with another row."""
    keyed = tasks.withColumn("_k", F.lower(safe_id(F.col(task_id))))
    repeated = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_k")
    return join_spread(keyed, repeated, "_k", how="left_semi").drop("_k")


def valid_tasks(tasks: DataFrame, adapter: str = fv.TASK_ADAPTER) -> DataFrame:
    return tasks.join(registry_report(tasks, adapter).select("path"), "path", "left_anti")


def registry_order(tasks: DataFrame, task_id: str = "task_id", person: str = "person") -> DataFrame:
    """Tasks in natural order of their id, then by person."""
    key = natural_key(F.col(task_id))
    return tasks.withColumn("sort_key", key).orderBy("sort_key", person)


def registry_ordinals(
    tasks: DataFrame, task_id: str = "task_id", person: str = "person", ties: Sequence[str] = (), name: str = "ordinal",
) -> DataFrame:
    """The same order as a number from 0 on; of one id and person, rows stand in the order of `ties`."""
    return with_ordinal(tasks.withColumn("sort_key", natural_key(F.col(task_id))), ["sort_key", person, *ties], name=name)


def tasks_by_person(tasks: DataFrame, task_id: str = "task_id", person: str = "person") -> DataFrame:
    """Tasks grouped by person: people by their smallest id, tasks in natural order inside.

    The group is an order, not an array: each row carries its person's first id and task count.
    """
    keyed = tasks.withColumn("sort_key", natural_key(F.col(task_id)))
    people = keyed.groupBy(person).agg(
        F.min("sort_key").alias("person_key"),
        F.min_by(task_id, "sort_key").alias("first_task_id"),
        F.count(F.lit(1)).alias("n_tasks"),
    )
    return join_spread(keyed, people, person, by=task_id).orderBy("person_key", person, "sort_key")


def targets_dim(spark: SparkSession) -> DataFrame:
    """The fixed target codes with their person, week and week label."""
    labels = dict(fv.TARGET_WEEK_LABELS)
    rows = [(code, person, week, labels[week]) for code, person, week in fv.TARGETS]
    return spark.createDataFrame(rows, "target STRING, person STRING, week INT, week_label STRING")


def resolve_targets(targets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Which task each target code means: `unique` with its id, `none` or `ambiguous`.

    A task with an explicit target answers to that alone; any other task answers when its text
    names the week's label or its week field is the week's number or label.
    """
    explicit = F.lower(strip_ws(F.coalesce("mock_target", F.lit(""))))
    week = strip_ws(F.coalesce("mock_week", F.lit("")))
    matches = F.when(explicit != "", explicit == F.col("target")).otherwise(
        F.contains(F.coalesce("task", F.lit("")), F.col("week_label"))
        | (week == F.col("week").cast("string"))
        | (week == F.col("week_label"))
    )
    task_id = strip_ws(F.coalesce("absolute_id", F.lit("")))
    hits = (
        tasks.join(targets, "person")
        .where(matches & (task_id != ""))
        .groupBy("target")
        .agg(F.count(F.lit(1)).alias("n"), F.min(task_id).alias("task_id"))
    )
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")
    return targets.join(hits, "target", "left").select(
        "target", "person", "week", n.alias("n_matches"), status.alias("status"),
        F.when(n == 1, F.col("task_id")).alias("task_id"),
    )


def task_target(weeks: Sequence[tuple[int, str]] = fv.TASK_WEEK_LABELS) -> Column:
    """Target code of a task row, from `mock_target`, else its person's `prefix` and week."""
    explicit = F.lower(strip_ws(F.coalesce("mock_target", F.lit(""))))
    raw_week = F.col("mock_week")
    number = F.when(raw_week.rlike("^[0-9]+$"), raw_week.try_cast("int"))
    labelled = F.lit(None).cast("int")
    for week, label in reversed(list(weeks)):
        labelled = F.when(F.contains(F.coalesce("task", F.lit("")), F.lit(label)), week).otherwise(labelled)
    week = F.coalesce(number, labelled)
    known = week.isin(*[w for w, _ in weeks])
    return F.when(explicit != "", explicit).when(
        F.col("prefix").isNotNull() & known, F.concat(F.col("prefix"), week.cast("string"))
    )


def assign_targets(
    tasks: DataFrame, prefixes: DataFrame, weeks: Sequence[tuple[int, str]] = fv.TASK_WEEK_LABELS
) -> DataFrame:
    """Tasks with their target code, or the reason there is none. `prefixes`: person -> prefix."""
    target = task_target(weeks=weeks)
    problem = F.when(target.isNotNull(), F.lit(None).cast("string")).when(
        F.col("prefix").isNull(), "unknown-person"
    ).otherwise("unknown-week")
    return tasks.join(prefixes, "person", "left").select(
        *tasks.columns, target.alias("target"), problem.alias("target_problem")
    )


def select_tasks(
    tasks: DataFrame, ids: DataFrame | None = None, persons: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(tasks kept by both filters, requested ids that do not exist).

    Unknown persons silently select nothing."""
    kept, unknown = tasks, None
    if ids is not None:
        unknown = ids.select("task_id").subtract(tasks.select("task_id"))
        kept = kept.join(ids.select("task_id").distinct(), "task_id", "left_semi")
    if persons is not None:
        kept = kept.join(persons.select("person").distinct(), "person", "left_semi")
    return kept, unknown


def pending_tasks(tasks: DataFrame, ledger: DataFrame, rerun: bool = False, task_id: str = "task_id") -> DataFrame:
    """Tasks without a completed marker in the current view of the ledger; all tasks on a rerun."""
    if rerun:
        return tasks
    done = ledger.where(F.col("marker") == "complete").select(F.col("case_id").alias(task_id)).distinct()
    return tasks.join(done, task_id, "left_anti")


def next_batch_version(
    used: DataFrame, requested: DataFrame | None = None, run_date: str = "run_date", version: str = "version"
) -> DataFrame:
    """Smallest free version per requested MMDD; gaps are filled, years share numbers.

    `requested` has a `run_date` column; without it the used dates are answered. A date without any version
    gets 1, dates that are not dates give no row. After `distinct` a day holds at most 9999 rows, so the window
    is small by construction. `next_version` is null when a day is full.
    """
    day = lambda df: df.select(run_mmdd(F.col(run_date)).alias("mmdd")).where("mmdd is not null").distinct()
    days = used.select(run_mmdd(F.col(run_date)).alias("mmdd"), F.col(version).cast("int").alias("v"))
    taken = days.where(F.col("mmdd").isNotNull() & F.col("v").between(1, fv.MAX_BATCH_VERSION)).distinct()
    ranked = taken.withColumn("rn", F.row_number().over(Window.partitionBy("mmdd").orderBy("v")))
    free = ranked.groupBy("mmdd").agg(
        (F.count_if(F.col("v") == F.col("rn")) + 1).alias("next_version"), F.count(F.lit(1)).alias("n_used")
    )
    asked = day(used if requested is None else requested).join(free, "mmdd", "left")
    following = F.coalesce("next_version", F.lit(1))
    return asked.select(
        "mmdd", F.coalesce("n_used", F.lit(0)).alias("n_used"),
        F.when(following <= fv.MAX_BATCH_VERSION, following).alias("next_version"),
    )


def batch_name(mmdd: Column, version: Column, prefix: str = fv.BATCH_PREFIX) -> Column:
    return F.concat(F.lit(prefix + "-"), mmdd, F.lit("-v"), version.cast("string"))

