import json

from pyspark.sql import functions as F

from runlens.functions.text import reply_verdict
from runlens.operators import runs as ops
from runlens.sources import meta_store
from runlens.sources.sinks import append_ledger, ledger_rows, read_ledger, write_ledger_batch, write_sorted, write_texts


def ledger(spark, rows):
    return spark.createDataFrame(rows, "case_id string, attempt int, marker string, failure_kind string")


def test_run_outcome(spark):
    names = ["prep", "intr", "time", "err", "miss", "other"]
    rows = [(False,) * 6, (False, False, True, True, True, True), (False, False, False, True, True, True),
            (False, False, False, False, True, True), (False, False, False, False, False, True),
            (False, True, True, True, True, True), (True, True, True, True, True, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} boolean" for n in names))
    outcome, kind = ops.run_outcome(*[F.col(n) for n in names])
    got = [tuple(r) for r in df.orderBy("i").select(outcome, kind).collect()]
    assert got == [("complete", None), ("failed", "timeout"), ("failed", "agent-error"), ("failed", "missing-deliverables"),
                   ("failed", "execution-error"), ("interrupted", None), ("failed", "data-preparation")]


def test_attempts(spark):
    df = ledger(spark, [
        ("a", 1, "failed", "timeout"), ("a", 2, "complete", None), ("b", 1, "failed", "missing-deliverables"),
        ("c", 1, "failed", "agent-error"), ("c", 2, "failed", "timeout"), ("c", 3, "complete", None),
        ("d", 1, "complete", None), ("d", 2, "complete", None)])
    got = {r.case_id: (r.n_attempts, r.final_marker, r.retry_eligible, r.retry_recovered, r.policy_violation)
           for r in ops.attempts(df).collect()}
    assert got == {"a": (2, "complete", True, True, False), "b": (1, "failed", False, False, False),
                   "c": (3, "complete", True, True, True), "d": (2, "complete", False, False, True)}


def test_task_status(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id string")
    df = ledger(spark, [("a", 1, "failed", None), ("a", 1, "complete", None), ("b", 1, "failed", None), ("b", 2, "complete", None),
                        ("c", 1, "interrupted", None), ("c", 1, "failed", None), ("d", 1, "odd", None)])
    got = {r.case_id: r.execution_outcome for r in ops.task_status(tasks, df).collect()}
    assert got == {"a": "failed", "b": "complete", "c": "interrupted", "d": "not-run"}
    assert ops.current_attempts(df).where("case_id='b'").count() == 1


def test_stop_on_error(spark):
    rows = [("p1", 1, False), ("p1", 2, False), ("p2", 1, False), ("p2", 2, True), ("p2", 3, False), ("p3", 1, True), ("p4", 1, False)]
    df = spark.createDataFrame(rows, "person string, task_no int, failed boolean")
    got = {(r.person, r.task_no) for r in ops.stop_on_error(df).where("executed").collect()}
    assert got == {("p1", 1), ("p1", 2), ("p2", 1), ("p2", 2)}
    assert ops.stop_on_error(df.withColumn("failed", F.lit(False))).where("executed").count() == len(rows)
    two = df.withColumn("b", F.lit("x")).unionByName(df.withColumn("b", F.lit("y")).withColumn("failed", F.lit(False)))
    by_batch = ops.stop_on_error(two, batch="b").where("executed").groupBy("b").count().collect()
    assert {r.b: r["count"] for r in by_batch} == {"x": 4, "y": len(rows)}
    late = spark.createDataFrame([("z", 2, True), ("a", 10, False)], "person string, task_no int, failed boolean")
    assert [r.person for r in ops.stop_on_error(late).where("executed").collect()] == ["z"]  # 2 stands before 10


def test_formats(spark):
    df = spark.createDataFrame([("a", "/x.HTM"), ("a", "/y.docx"), ("a", "/z.htm")], "case_id string, path string")
    assert ops.present_formats(df).first().present_formats == ["docx", "html"]
    req = spark.createDataFrame([("a", "html"), ("a", "pdf"), ("a", "pdf")], "case_id string, format string")
    have = spark.createDataFrame([("a", "html")], "case_id string, format string")
    assert [tuple(r) for r in ops.missing_format_rows(req, have).collect()] == [("a", "pdf")]


ENTRY = ("run_id string, task_id string, person string, execution_outcome string, metadata string, trace string, outputs string, "
         "marker string, run_dir string, has_metadata boolean, has_outputs boolean, has_run_dir boolean, has_trace boolean, has_marker boolean")


def entry(run, task, outcome, trace=True):
    return (run, task, "p", outcome, "/m", "/t", "/o", "/k", "/d", True, True, True, trace, outcome != "not-run")


def test_batch_and_handoff(spark, tmp_path):
    entries = spark.createDataFrame([
        entry("ok", "1", "complete"), entry("ok", "2", "failed", trace=False), entry("open", "1", "not-run"),
        entry("lost", "1", "complete", trace=False)], ENTRY)
    batches = spark.createDataFrame([("ok", True), ("open", True), ("lost", True), ("empty", True), ("cut", False)], "run_id string, finished boolean")
    ready = {r.run_id: (r.n_tasks, r.runner_finished) for r in ops.batch_ready(batches, entries).collect()}
    assert ready == {"ok": (2, True), "open": (1, False), "lost": (1, False), "empty": (0, True), "cut": (0, False)}
    headers, rows = ops.handoff(batches, entries)
    heads = {r.runId: r for r in headers.collect()}
    assert (heads["ok"].version, heads["ok"].adapter, heads["ok"].runnerFinished, heads["ok"].nTasks) == (1, "weekly-report", True, 2)
    assert heads["empty"].nTasks == 0 and heads["empty"].runnerFinished is True
    many = spark.createDataFrame([entry("r", t, "complete") for t in ("10", "2", "x", "1")], ENTRY)
    _, ordered = ops.handoff(batches, many)
    write_sorted(ordered, ["runId", "sort_key"], str(tmp_path / "h"))
    lines = [json.loads(x) for f in sorted((tmp_path / "h").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["taskId"] for x in lines] == ["1", "2", "10", "x"]
    first = rows.where("runId = 'ok' and taskId = '1'").first()
    assert (first.person, first.executionOutcome, first.metadata, first.trace, first.outputs, first.marker) == (
        "p", "complete", "/m", "/t", "/o", "/k")
    assert first.judgeInputs.asDict() == {"metadata": "/m", "data": None, "outputs": "/o", "runnerTaskDir": "/d"}
    assert rows.where("runId = 'ok' and taskId = '2'").first().trace is None


def test_manifest(spark):
    rows = [("big", "report", "/same.md", "pulled")] * 5000 + [("small", "worklog", "/w.md", "failed"), ("small", "odd", "/x", "failed")]
    df = spark.createDataFrame(rows, "case_id string, source string, path string, status string")
    records = ops.manifest(df)
    assert records.where("case_id = 'big' and section = 'outputs'").count() == 5000
    assert [(r.section, r.path) for r in records.where("case_id = 'small'").collect()] == [("worklogs", "/w.md")]
    cases = spark.createDataFrame([("big", "T1", "s1", "d", "log"), ("none", "T2", "s2", "d", "log")],
                                  "case_id string, task_id string, session_id string, pulled_at string, selection_source string")
    heads = {r.case_id: r for r in ops.manifest_headers(cases, df).collect()}
    assert (heads["big"].n_outputs, heads["big"].selection_source, heads["none"].n_outputs) == (5000, "log", 0)
    assert heads["none"].workspace.asDict() == {
        "session_root": "/workspace/s2", "worklog_root": "/workspace/memory/weekly-work-report/worklog",
        "summary_root": "/workspace/memory/weekly-work-report/summary"}


def test_meta_merge(spark):
    rows = [("a", 1, "session_id", "x"), ("a", 3, "session_id", None), ("a", 2, "dialog_verdict", "v"), ("b", 1, "custom", "t")]
    df = spark.createDataFrame(rows, "case_id string, seq int, field string, value string")
    merged = ops.meta_merge(df)
    expected = {("a", "session_id", None, 3), ("a", "dialog_verdict", "v", 2), ("b", "custom", "t", 1)}
    assert {tuple(r) for r in merged.collect()} == expected
    assert {tuple(r) for r in ops.meta_merge(merged.unionByName(df)).collect()} == expected
    assert {tuple(r) for r in ops.meta_wide(merged, ["session_id", "custom"]).collect()} == {("a", None, None), ("b", None, "t")}


def test_rollup(spark):
    df = spark.createDataFrame([("r", "p", True), ("r", "q", False), ("r", "q", True)], "run_id string, person string, ok_run boolean")
    got = {(r.run_id, r.person): (r.n_success, r.n_failed, r.ok) for r in ops.batch_rollup(df).collect()}
    assert got == {("r", "p"): (1, 0, True), ("r", "q"): (1, 1, False), ("r", None): (2, 1, False), (None, None): (2, 1, False)}


def test_run_results(spark):
    tasks = spark.createDataFrame([("a", "p", "写周报"), ("b", "p", "输出 pdf"), ("c", "p", "x"), ("d", "p", "x")], "case_id string, person string, task string")
    answers = spark.createDataFrame([("a", "stop", "周报已生成", "s1"), ("b", "error", "无法完成", "s2"), ("c", "stop", "是否继续生成", None)],
                                    "case_id string, outcome string, reply string, session_id string")
    files = spark.createDataFrame([("a", "report", "/r.docx", "pulled"), ("a", "report", "/r.htm", "pulled"), ("a", "summary", "/s.md", "pulled"),
                                   ("b", "report", "/r.pdf", "failed")], "case_id string, source string, path string, status string")
    got = {r.case_id: r for r in ops.run_results(tasks, answers, files, reply_verdict(F.col("reply"))).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.outcome, a.failure_kind, a.present_formats, a.outputs_pulled, a.summaries_pulled, a.dialog_verdict) == (
        "complete", None, ["docx", "html"], 2, 1, "complete")
    assert (b.failure_kind, b.missing_formats, b.dialog_verdict) == ("agent-error", ["pdf"], "not-started")
    assert (c.failure_kind, c.warnings, c.dialog_verdict) == ("missing-deliverables", ["missing-session-id"], "needs-confirmation")
    assert (d.failure_kind, d.session_id) == ("timeout", None)
    flagged = tasks.withColumns({"interrupted": F.col("case_id").isin("a", "b"), "preparation_failed": F.col("case_id") == "b"})
    got = {r.case_id: r for r in ops.run_results(flagged, answers, files, reply_verdict(F.col("reply"))).collect()}
    assert [(got[k].outcome, got[k].failure_kind) for k in "abd"] == [
        ("interrupted", None), ("failed", "data-preparation"), ("failed", "timeout")]
    assert (got["a"].dialog_verdict, got["b"].dialog_verdict, got["b"].session_id) == ("complete", "not-started", None)


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1, "complete", 3, None), ("b", 1, "failed", 0, "timeout")],
                                 "case_id string, attempt int, outcome string, outputs_pulled int, failure_kind string").withColumn(
        "at", F.lit("2026-07-15 10:00:00").cast("timestamp"))
    path = str(tmp_path / "l")
    for _ in range(2):  # a retry replaces its batch
        append_ledger(runs, path, "one")
    write_ledger_batch(runs.withColumn("attempt", F.lit(2)), 7, path)
    back = read_ledger(spark, path)
    assert spark.read.parquet(path).count() == back.count() == 4 and {str(r.run_date) for r in back.collect()} == {"2026-07-15"}
    later = runs.withColumn("outcome", F.lit("complete")).withColumn("outputs_pulled", F.lit(9)).withColumn("at", F.expr("at + interval 1 hour"))
    append_ledger(later, path, "correction")
    again = {(r.case_id, r.attempt): r for r in read_ledger(spark, path).where("marker = 'complete'").collect()}
    assert json.loads(again["a", 1].result) == {"outputs_pulled": 9} and json.loads(again["a", 2].result) == {"outputs_pulled": 3}
    assert json.loads(back.where("case_id='a'").first().result) == {"outputs_pulled": 3}
    assert back.where("case_id='b'").first().result is None
    texts = spark.createDataFrame([("a", "prompt", "hi", "2026-07-15")], "case_id string, tag string, text string, run_date string")
    write_texts(texts, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().text == "hi"
    assert "at" in ledger_rows(runs).columns



def test_kept_metadata(spark, tmp_path):
    path = str(tmp_path / "meta")
    schema = "case_id string, field string, value string, seq long"
    writes = [
        [("a", "x", "1", 1), ("a", "y", "1", 5), ("b", "x", None, 2)],
        [("a", "x", None, 2), ("a", "y", "older", 3), ("c", "x", "1", 1)],
        [("a", "y", "same seq, later write", 5), ("b", "z", "2", 9)],
    ]
    frames = [spark.createDataFrame(w, schema) for w in writes]
    state = lambda: {(r.case_id, r.field): (r.value, r.seq) for r in meta_store.read_meta(spark, path).collect()}
    assert state() == {} and meta_store.compact(spark, path) is None
    for number in (1, 2):
        assert meta_store.append_updates(frames[number - 1], path, number)
    two = state()
    assert two == {("a", "x"): (None, 2), ("a", "y"): ("1", 5), ("b", "x"): (None, 2), ("c", "x"): ("1", 1)}
    merged = ops.meta_merge(frames[0].unionByName(frames[1])).collect()
    assert two == {(r.case_id, r.field): (r.value, r.seq) for r in merged}
    meta_store.append_updates(frames[1], path, 2)  # a repeated write
    assert state() == two and meta_store.compact(spark, path) == 2 and state() == two
    assert not meta_store.append_updates(frames[2], path, 2) and state() == two
    meta_store.append_updates(frames[2], path, 3)
    (tmp_path / "meta" / "delta-0000000004").mkdir()  # a write that died
    files = meta_store.read_meta(spark, path).inputFiles()
    assert files and all("base-0000000002" in f or "delta-0000000003" in f for f in files)
    three = two | {("a", "y"): ("same seq, later write", 5), ("b", "z"): ("2", 9)}
    assert state() == three and meta_store.compact(spark, path) == 3 and state() == three and meta_store.compact(spark, path) == 3
