"""The chain from raw lines and listings to results, status and totals."""

import json

from pyspark.sql import functions as F

from runlens.functions.text import reply_verdict
from runlens.operators import chain

ROOT = "/workspace/"


def _line(reason, session="s1", text=None, at="2024-01-01T00:00:00Z", role="main"):
    content = [] if text is None else [{"type": "text", "text": text}]
    return json.dumps({"event": "model_output", "agent_role": role, "session_id": session, "timestamp": at,
                       "payload": {"assistant": {"stop_reason": reason, "content": content}}})


def _results(spark, lines, files):
    tasks = spark.createDataFrame([(k, "p" if k < 4 else "q", "输出 pdf") for k in range(1, 7)], "case_id long, person string, task string")
    lines = spark.createDataFrame([(k, n, x) for k, own in lines.items() for n, x in enumerate(own)], "case_id long, byte_offset long, line string")
    files = spark.createDataFrame(files, "case_id long, path string, size long, status string")
    return tasks, chain.results(tasks, lines, files, reply_verdict(F.col("reply")), timeout_seconds=60)


def test_chain(spark):
    lines = {
        1: [_line("tool_use", "sub", role="sub"), "not json", _line("stop", "s1", "周报已生成")],
        2: [_line("tool_use", "s2"), _line("error", "s2")],
        3: [_line("stop", " ", "done")],  # no session
        4: [_line("tool_use"), _line("stop", at="2024-01-01T00:01:00Z", text="late")],
        5: [_line("stop", 5, "a number is no session")],
        9: [_line("stop", text="no such task")],
    }
    files = [
        (1, ROOT + "s1/a.pdf", 1, "pulled"), (1, ROOT + "s1/deep/b.docx", 1, "pulled"), (1, ROOT + "s2/c.pdf", 1, "pulled"),
        (1, ROOT + "memory/weekly-work-report/worklog/w.md", 1, "pulled"), (1, ROOT + "memory/weekly-work-report/summary/w.md", 1, "failed"),
        (2, ROOT + "s2/a.pdf", 1, "failed"), (3, ROOT + "memory/weekly-work-report/worklog/w.md", 1, "pulled"),
        (4, ROOT + "s1/a.pdf", 1, "pulled"), (None, ROOT + "s1/a.pdf", 1, "pulled"),
    ]
    tasks, found = _results(spark, lines, files)
    got = {r.case_id: r for r in found.collect()}
    assert set(got) == set(range(1, 7))
    assert (got[1].outcome, got[1].outputs_pulled, got[1].worklogs_pulled, got[1].summaries_pulled, got[1].session_id) == ("complete", 1, 1, 0, "s1")
    assert [got[k].failure_kind for k in range(2, 7)] == [
        "agent-error", "missing-deliverables", "timeout", "missing-deliverables", "timeout"]
    assert (got[3].worklogs_pulled, got[3].warnings, got[5].session_id) == (0, ["missing-session-id"], None)

    earlier = spark.createDataFrame([(1, 1, "failed"), (6, 1, "complete"), (6, 0, "failed")], "case_id long, attempt int, marker string")
    tasks = tasks.withColumn("run_id", F.col("case_id") % 2)
    entries = chain.status(tasks, earlier, found.where("case_id <> 6"), attempt=7)
    assert {r.case_id: r.execution_outcome for r in entries.collect()} == {
        1: "complete", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "complete"}
    batches = spark.createDataFrame([(0,), (1,), (2,)], "run_id long")
    rows = {(r.run_id, r.person): (r.n_success, r.n_failed, r.runner_finished) for r in chain.totals(batches, entries).collect()}
    assert rows[None, None] == (2, 4, None)
    assert rows[1, None] == (1, 2, True)  # case 1 is complete and holds all inputs
    assert rows[0, None] == (1, 2, False)  # case 6 is complete without this run's files


def test_chain_of_nothing(spark):
    _, found = _results(spark, {1: ["", "[]"]}, [(1, "/elsewhere/a.pdf", 1, "pulled")])
    assert {r.failure_kind for r in found.collect()} == {"timeout"}
    none = chain.results(*[df.where("false") for df in (
        spark.createDataFrame([(1, "p", "x")], "case_id long, person string, task string"),
        spark.createDataFrame([(1, 0, "x")], "case_id long, byte_offset long, line string"),
        spark.createDataFrame([(1, "x", 1, "x")], "case_id long, path string, size long, status string"))], F.col("reply"))
    assert none.count() == 0
