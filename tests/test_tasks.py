import json

from pyspark.sql import functions as F

from runlens.operators import tasks as ops
from runlens.operators.common import first_per_key
from runlens.sources.registry import read_prompts, read_registry


def write_task(root, folder_name, dir_id, **fields):
    base = {"adapter": "weekly-report", "person": folder_name, "absolute_id": dir_id, "task": "写周报"}
    folder = root / folder_name / dir_id
    folder.mkdir(parents=True)
    (folder / "metadata.json").write_text(json.dumps({**base, **fields}, ensure_ascii=False), encoding="utf-8")


def test_registry(spark, tmp_path):
    write_task(tmp_path, "苏晚", "10", absolute_id=10)
    write_task(tmp_path, "苏晚", "9", mock_week=2)
    write_task(tmp_path, "唐可", "T1")
    write_task(tmp_path, "唐可", "t1")
    write_task(tmp_path, "唐可", "true", absolute_id=True)
    write_task(tmp_path, "唐可", "x", adapter="other", person="苏晚", task=" ")
    write_task(tmp_path, "唐可", "a b", absolute_id="c")
    write_task(tmp_path, "唐可", "n", task=5)
    (tmp_path / "唐可" / "deeper" / "q").mkdir(parents=True)
    (tmp_path / "唐可" / "deeper" / "q" / "metadata.json").write_text("{}")
    for name, text in (("broken", "{\"adapter\": "), ("list", "[1]"), ("empty", " ")):
        (tmp_path / "唐可" / name).mkdir()
        (tmp_path / "唐可" / name / "metadata.json").write_text(text)
    registry = read_registry(spark, str(tmp_path))
    assert registry.count() == 11
    found = {}
    for r in ops.registry_report(registry).join(registry.select("path", "dir_id"), "path").collect():
        found.setdefault(r.dir_id, set()).add(r.violation)
    assert found == {"T1": {"duplicate-id"}, "t1": {"duplicate-id"}, "true": {"id-wrong-type"},
                     "x": {"adapter", "person-directory", "blank-task"}, "a b": {"id-directory"}, "n": {"blank-task"},
                     **{name: {"invalid-json"} for name in ("broken", "list", "empty")}}
    good = ops.valid_tasks(registry).withColumnRenamed("absolute_id", "task_id")
    assert [r.task_id for r in ops.registry_order(good).collect()] == ["9", "10"]
    assert {r.task_id: r.mock_week for r in good.collect()} == {"9": "2", "10": None}


def test_people_order(spark):
    df = spark.createDataFrame([("x", "10"), ("y", "9"), ("x", "2"), ("z", "a"), ("y", "B")], "person string, task_id string")
    assert [(r.person, r.task_id) for r in ops.tasks_by_person(df).collect()] == [
        ("x", "2"), ("x", "10"), ("y", "9"), ("y", "B"), ("z", "a")]


def test_resolve_targets(spark):
    schema = "person string, absolute_id string, task string, mock_target string, mock_week string"
    tasks = spark.createDataFrame([
        ("苏晚", "1", "第一周", None, None), ("苏晚", "2", "第一周", " S2 ", None), ("唐可", "3", "x", None, "1"),
        ("唐可", "4", "第一周", None, None), ("zhouzeyu", "5", "firstweek", None, None), ("陈景明", " ", "第一周", None, None),
        ("方一诺", "7", "", None, "第二周"),
    ], schema)
    got = {r.target: (r.status, r.task_id) for r in ops.resolve_targets(ops.targets_dim(spark), tasks).collect()}
    assert got == {"s1": ("unique", "1"), "s2": ("unique", "2"), "t1": ("ambiguous", None), "t2": ("none", None),
                   "z1": ("unique", "5"), "z2": ("none", None), "c1": ("none", None), "c2": ("none", None),
                   "f1": ("none", None), "f2": ("unique", "7")}


def test_assign_targets(spark):
    from runlens.functions.fixed_values import PERSON_PREFIXES

    prefixes = spark.createDataFrame(list(PERSON_PREFIXES), "person string, prefix string")
    rows = [("苏晚", "第二周", None, None), ("苏晚", "第二周和第一周", None, None), ("苏晚", "x", None, "2"),
            ("苏晚", "第一周", None, "3"), ("nobody", "第一周", None, None), ("nobody", "", " Z9 ", None), ("唐可", "月报", None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, person string, task string, mock_target string, mock_week string")
    got = [(r.target, r.target_problem) for r in ops.assign_targets(df, prefixes).orderBy("i").collect()]
    assert got == [("s2", None), ("s1", None), ("s2", None), (None, "unknown-week"), (None, "unknown-person"), ("z9", None),
                   (None, "unknown-week")]


def test_selection(spark):
    tasks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "task_id string, person string")
    ids = spark.createDataFrame([("1",), ("2",), ("9",)], "task_id string")
    people = spark.createDataFrame([("a",), ("nobody",)], "person string")
    kept, unknown = ops.select_tasks(tasks, ids, people)
    assert [r.task_id for r in kept.collect()] == ["1"] and [r.task_id for r in unknown.collect()] == ["9"]
    ledger = spark.createDataFrame([("1", "complete"), ("2", "failed")], "case_id string, marker string")
    assert sorted(r.task_id for r in ops.pending_tasks(tasks, ledger).collect()) == ["2", "3"]
    assert ops.pending_tasks(tasks, ledger, rerun=True).count() == 3


def test_next_version(spark):
    used = [("20260715", 1), ("20260715", 2), ("20250715", 4), ("20260715", 2), ("20260801", 2), ("bad", 1)]
    used += [("20260901", n) for n in range(1, 10000)]
    df = spark.createDataFrame(used, "run_date string, version long")
    got = {r.mmdd: r.next_version for r in ops.next_batch_version(df).collect()}
    assert got == {"0715": 3, "0801": 1, "0901": None}


def test_next_version_of_unused_dates(spark):
    used = spark.createDataFrame([("20260715", 1)], "run_date string, version long")
    asked = spark.createDataFrame([("20260715",), ("20261231",), ("nonsense",)], "run_date string")
    assert {tuple(r) for r in ops.next_batch_version(used, asked).collect()} == {("0715", 1, 2), ("1231", 0, 1)}


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, v string")
    assert sorted(tuple(r) for r in first_per_key(df, "k", F.col("n"), "v").collect()) == [("a", "y"), ("b", "z")]


def test_read_prompts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfdo it")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.text if not r.problem else None, r.problem) for r in read_prompts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("do it", None), "b.txt": (None, "invalid-utf8")}
