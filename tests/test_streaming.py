import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from runlens.operators import traces as batch
from runlens.operators.listings import first_stable_poll, snapshot_diff, stability_runs
from runlens.sources.sinks import read_ledger
from runlens.sources.traces import parse_events
from runlens.streaming.changes import start_ledger, stream_changes, stream_replies
from runlens.streaming.stability import detect_stable
from runlens.streaming.terminal import detect_terminal, tail_events, tail_traces

START = datetime(2026, 7, 1, tzinfo=timezone.utc)


def line(second, role="main", reason="tool_use", text=None):
    content = [{"type": "text", "text": text}] if text else []
    return json.dumps({
        "event": "model_output", "agent_role": role, "session_id": "s",
        "timestamp": (START + timedelta(seconds=second)).isoformat().replace("+00:00", "Z"),
        "payload": {"assistant": {"stop_reason": reason, "content": content}}}, ensure_ascii=False) + "\n"


def drain(df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None


class Tail:
    """A memory query over growing files, advanced by hand."""

    def __init__(self, df, name, checkpoint):
        self.query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).start()

    def step(self):
        self.query.processAllAvailable()
        assert self.query.exception() is None

    def stop(self):
        self.query.stop()


def test_tail_follows_growth(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.write_text("old\nnew1\nhalf")
    tail = Tail(tail_traces(spark, str(tmp_path / "in"), json.dumps({str(a): 4})), "tail", str(tmp_path / "cp"))
    try:
        tail.step()
        with a.open("a") as f:
            f.write("-done\n")
        b.write_text("b1\n")
        tail.step()
        with b.open("a") as f:
            f.write("b2\nrest")
        tail.step()
    finally:
        tail.stop()
    got = sorted((r.trace[-7:], r.byte_offset, r.line) for r in spark.table("tail").collect())
    assert got == [("a.jsonl", 4, "new1"), ("a.jsonl", 9, "half-done"), ("b.jsonl", 0, "b1"), ("b.jsonl", 3, "b2")]


def test_terminal_matches_batch(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = {f"t{i}": sorted((rng.randint(0, 400), rng.choice(["main", "sub"]), rng.choice(["stop", "error", "x", "x", "x", "x"]))
                             for _ in range(rng.randint(1, 12))) for i in range(12)}
    lines["quiet"] = [(0, "main", "x")]
    lines["late"] = [(0, "main", "x"), (100, "main", "stop")]
    lines["clock"] = [(0, "main", "x"), (5000, "sub", "x")]
    events = detect_terminal(tail_events(spark, str(folder)), timeout_seconds=100)
    tail = Tail(events, "terminal", str(tmp_path / "cp"))
    try:
        for begin in (0, 150, 300):
            for name, rows in lines.items():
                with (folder / f"{name}.jsonl").open("a") as f:
                    f.writelines(line(s, role, reason) for s, role, reason in rows
                                 if begin <= s < begin + 150 or (begin == 300 and s >= 450))
            tail.step()
        with (folder / "clock.jsonl").open("a") as f:
            f.write(line(9000, "sub"))
        tail.step()
        tail.step()
    finally:
        tail.stop()
    got = {r.trace.rsplit("/", 1)[1][:-6]: r.outcome for r in spark.table("terminal").collect()}
    assert spark.table("terminal").count() == len(got)
    rows = [(n, i, role, reason, s) for n, rs in lines.items() for i, (s, role, reason) in enumerate(rs)]
    df = spark.createDataFrame(rows, "trace string, byte_offset long, agent_role string, stop_reason string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    want = {r.trace: r.outcome for r in batch.outcome_with_timeout(df, 100).collect()}
    assert got == want
    assert set(want.values()) == {"stop", "error", "timeout"}


def test_terminal_without_times(spark, tmp_path):
    """Events without a time: one answer per trace, the same however the lines fall into batches."""
    timeless = lambda reason: json.dumps({**json.loads(line(0, reason=reason)), "timestamp": None}) + "\n"
    lines = {
        "none": [timeless("x"), timeless("stop")], "after": [line(10), timeless("error")], "before": [timeless("x"), line(20, reason="stop")],
        "earlier": [line(90, "sub"), line(0), line(95, reason="stop")], "late": [line(0), line(500, reason="stop"), timeless("stop")]}
    found = []
    for run, steps in enumerate([[slice(0, 3)], [slice(0, 1), slice(1, 2), slice(2, 3)]]):
        folder = tmp_path / f"in{run}"
        folder.mkdir()
        tail = Tail(detect_terminal(tail_events(spark, str(folder)), timeout_seconds=100, lateness="1 hour"), f"timeless{run}", str(tmp_path / f"cp{run}"))
        try:
            for step in steps:
                for name, own in lines.items():
                    with (folder / f"{name}.jsonl").open("a") as f:
                        f.writelines(own[step])
                tail.step()
        finally:
            tail.stop()
        rows = spark.table(f"timeless{run}").collect()
        found.append({r.trace.rsplit("/", 1)[1][:-6]: r.outcome for r in rows})
        assert len(rows) == len(found[-1])
    want = {"none": "stop", "after": "error", "before": "stop", "earlier": "stop", "late": "timeout"}
    assert found == [want, want]
    rows = [(n, i, json.loads(t)) for n, own in lines.items() for i, t in enumerate(own)]
    df = spark.createDataFrame(
        [(n, i, e["agent_role"], e["payload"]["assistant"]["stop_reason"], e["timestamp"]) for n, i, e in rows],
        "trace string, byte_offset long, agent_role string, stop_reason string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert {r.trace: r.outcome for r in batch.outcome_with_timeout(df, 100).collect()} == want


def test_stability_matches_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{i}", p, rng.choice("xxy"), rng.random() < 0.8) for i in range(8) for p in range(10)]
    schema = "session_id string, poll_no long, signature string, present boolean"
    for part in range(5):
        spark.createDataFrame([r for r in rows if r[1] // 2 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    polls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(detect_stable(polls, 3), "stable", str(tmp_path / "cp"))
    got = {r.session_id: r.poll_no for r in spark.table("stable").collect()}
    runs = stability_runs(spark.createDataFrame(rows, schema))
    want = {r.session_id: r.poll_no for r in first_stable_poll(runs, 3).where("stable").collect()}
    assert got == want and got


def test_stability_of_shuffled_polls(spark, tmp_path):
    rng = random.Random(8)
    at = lambda p: START + timedelta(minutes=p)
    rows = [(f"s{i}", p, rng.choice("xxy"), rng.choice([True, True, True, False, None]), at(p)) for i in range(12) for p in range(30)]
    schema = "session_id string, poll_no long, signature string, present boolean, at timestamp"
    loose = [(None, 3, "x", True, at(3)), ("s1", None, "x", True, at(3)), ("s2", 99, "x", True, None)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 12)) + loose  # up to twelve minutes late
    steps = [mixed[k * 61:(k + 1) * 61] for k in range(6)]
    steps += [[("tick", 0, "x", False, at(300))], [("tick", 1, "x", False, at(100_000))]]
    (tmp_path / "in").mkdir()
    polls = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    tail = Tail(detect_stable(polls, 3, "at", "1 hour", retention_seconds=86400), "shuffled", str(tmp_path / "cp"))
    try:
        for step in steps:
            spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            tail.step()
        assert sum(p["numRowsTotal"] for p in tail.query.lastProgress["stateOperators"]) <= 8  # of the last tick alone
    finally:
        tail.stop()
    got = [(r.session_id, r.poll_no) for r in spark.table("shuffled").collect()]
    runs = stability_runs(spark.createDataFrame(rows, schema).drop("at"))
    want = [(r.session_id, r.poll_no) for r in first_stable_poll(runs, 3).where("stable").collect()]
    assert sorted(got) == sorted(want) and len(got) > 5


def test_changes_match_batch(spark, tmp_path):
    schema = "path string, size long, mtime long"
    base = spark.createDataFrame([("a", 1, 1), ("b", 5, 5), ("c", 1, 1)], schema)
    now = spark.createDataFrame([("a", 2, 1), ("b", 4, 5), ("d", 0, 0), ("c", 1, 2)], schema)
    now.write.parquet(str(tmp_path / "in"))
    drain(stream_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base), "changes", str(tmp_path / "cp"))
    got = {(r.path, r.change_kind) for r in spark.table("changes").collect()}
    assert got == {(r.path, r.change_kind) for r in snapshot_diff(now, base).collect() if r.change_kind != "same"}


def test_replies_and_ledger(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(line(0) + line(1, reason="stop", text="周报已生成") + line(2, "sub", "stop", "x")
                                    + line(3, reason="stop", text="再次完成，周报已生成"), encoding="utf-8")
    (folder / "b.jsonl").write_text(line(5, reason="stop", text="无法完成"), encoding="utf-8")
    replies = stream_replies(tail_events(spark, str(folder)))
    runs = replies.select(
        F.col("trace").alias("case_id"), F.lit(1).alias("attempt"), F.lit("complete").alias("marker"), F.col("ts").alias("at"),
        F.col("byte_offset").alias("seq"), "verdict", "reply")
    query = start_ledger(runs, str(tmp_path / "ledger"), str(tmp_path / "cp"), processingTime="0 seconds")
    try:
        query.processAllAvailable()
        assert query.exception() is None
    finally:
        query.stop()
    ledger = read_ledger(spark, str(tmp_path / "ledger"))
    got = sorted((r.case_id.rsplit("/", 1)[1], json.loads(r.result)["verdict"]) for r in ledger.collect())
    assert got == [("a.jsonl", "complete"), ("a.jsonl", "complete"), ("b.jsonl", "partial-or-failed")]


def test_a_replayed_batch_leaves_each_reply_once(spark, tmp_path):
    """A stream that dies after its write and before its commit runs the batch again."""
    schema = "case_id string, attempt int, marker string, at timestamp, seq long, reply string"
    first = spark.createDataFrame([("a", 1, "complete", START, k, f"r{k}") for k in range(5)], schema)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda: start_ledger(stream(), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    for file in (tmp_path / "cp" / "commits").iterdir():
        file.unlink()  # the commit was lost
    run()
    spark.createDataFrame([("a", 1, "complete", START, 5, "r5")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 6
    assert sorted(json.loads(r.result)["reply"] for r in read_ledger(spark, str(tmp_path / "ledger")).collect()) == [f"r{k}" for k in range(6)]


@pytest.mark.parametrize("escaped", [False, True])
def test_parse_is_the_same_for_escaped_text(spark, escaped):
    text = json.dumps({"event": "x", "agent_role": "main", "session_id": "会话"}, ensure_ascii=escaped)
    df = spark.createDataFrame([("t", 0, text)], "trace string, byte_offset long, line string")
    assert parse_events(df).first().session_id == "会话"
