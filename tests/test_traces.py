import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from runlens.functions.text import reply_verdict
from runlens.operators import traces as ops
from runlens.sources.jsonl_tail import JsonlTailSource, _lines, as_uri, list_sizes, split_ranges
from runlens.sources.traces import (
    envelope, parse_events, read_trace_lines, read_trace_text, terminal_candidates, write_events,
)

GOLDEN = [
    '{"event":"model_output","agent_role":"main","session_id":"s0","payload":{"assistant":{"stop_reason":"tool_use","content":[]}}}',
    "{bad json",
    "[1,2]",
    '{"event":"model_output","agent_role":"sub","session_id":"s2","payload":{"assistant":{"stop_reason":"error"}}}',
    '{"event":"model_output","agent_role":"main","session_id":"s1","payload":{"assistant":{"stop_reason":"stop","content":[{"type":"text","text":"周报"},{"type":"image"},"x",{"type":"text","text":"已生成"}]}}}',
    '{"event":"model_output","agent_role":"main","session_id":"s1","payload":{"assistant":{"stop_reason":"stop","content":[{"type":"image"}]}}}',
]


@pytest.fixture()
def golden(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join(GOLDEN), encoding="utf-8")
    return parse_events(read_trace_lines(spark, str(tmp_path)))


def test_golden(golden):
    assert golden.count() == 4
    assert ops.latest_terminal(golden).first()[1:] == ("stop", True)
    reply = ops.last_reply(golden)
    assert reply.first().reply == "周报已生成"
    assert reply.select(reply_verdict(F.col("reply"))).first()[0] == "complete"
    assert ops.main_session(golden, is_text="session_is_text").first().session_id == "s0"
    assert ops.stop_count_last_n(golden, 2).first().n_stop == 2
    assert ops.stop_count_last_n(golden, 1).first().n_stop == 1


@pytest.mark.parametrize("line,ok", [
    ('{"a":1}', True), ("  {} ", True), ("", False), ("null", False), ("12", False), ("{}{}", False),
    ("{},{}", False), ("{}]", False), ('{"a":1} x', False), ("{'a':1}", False), ('{"a":1,}', False),
    ('{"a":NaN}', True), ('{"a":1,"a":2}', True), ('"{}"', False), ("[{}]", False),
])
def test_envelope(spark, line, ok):
    df = spark.createDataFrame([(line,)], "v string")
    assert df.select(envelope(F.col("v")).isNotNull()).first()[0] is ok


def test_session_rules(spark):
    lines = ['{"session_id":5,"agent_role":"main"}', '{"session_id":" ","agent_role":"main"}',
             '{"session_id":"sub1"}', '{"session_id":" main1 ","agent_role":"main"}']
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(lines)], "trace string, byte_offset long, line string")
    events = parse_events(df)
    assert ops.main_session(events, is_text="session_is_text").first().session_id == "main1"
    assert ops.main_session(events.where("byte_offset < 3"), is_text="session_is_text").first().session_id == "sub1"
    assert ops.main_session(events.where("byte_offset < 2"), is_text="session_is_text").first().session_id is None


def test_empty_last_reply_is_null(spark):
    stop = lambda text: json.dumps({"event": "model_output", "agent_role": "main", "payload": {
        "assistant": {"stop_reason": "stop", "content": [{"type": "text", "text": text}]}}})
    df = spark.createDataFrame([("t", 0, stop("a")), ("t", 1, stop(""))], "trace string, byte_offset long, line string")
    assert ops.last_reply(parse_events(df)).first().reply is None


def test_created_time(spark):
    rows = [("a", 0, '{"timestamp":"2026-07-01T00:00:05Z"}'), ("a", 1, '{"timestamp":"2025-01-01T00:00:00Z"}'),
            ("b", 0, "junk"), ("b", 1, '{"timestamp":"2025-01-01T00:00:00Z"}'), ("c", 0, '{"timestamp":7}')]
    lines = parse_events(spark.createDataFrame(rows, "trace string, byte_offset long, line string"), keep_malformed=True)
    mtimes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 200)], "trace string, mtime long")
    got = {r.trace: r.c for r in ops.created_time(lines, mtimes).select("trace", F.unix_timestamp("created").alias("c")).collect()}
    assert got == {"a": 1782864005, "b": 100, "c": 200}


def test_prefilter_keeps_terminals(spark):
    rows = [(GOLDEN[4],), (GOLDEN[4].replace("main", "m\\u0061in"),), ('{"event":"x"}',)]
    df = spark.createDataFrame(rows, "line string")
    assert terminal_candidates(df).count() == 2


def test_timeout(spark):
    rows = [("a", 0, "main", "tool_use", 0), ("a", 1, "main", "stop", 1799), ("b", 0, "main", "x", 0),
            ("b", 1, "main", "stop", 1800), ("c", 0, "sub", "stop", 0), ("d", 0, "main", "error", 5), ("d", 1, "main", "stop", 6)]
    df = spark.createDataFrame(rows, "trace string, byte_offset long, agent_role string, stop_reason string, s long").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {r.trace: r.outcome for r in ops.outcome_with_timeout(df).collect()}
    assert got == {"a": "stop", "b": "timeout", "c": "timeout", "d": "error"}
    latest = {r.trace: r.stop_reason for r in ops.latest_terminal(df).collect()}
    assert latest == {"a": "stop", "b": "stop", "c": None, "d": "stop"}


def test_last_n_and_repartition_invariance(spark):
    rng = random.Random(1)
    rows = [(f"t{rng.choice([0, 0, 0, 1, 2])}", i, rng.choice(["main", "sub"]), rng.choice(["stop", "error", "tool_use"]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "trace string, byte_offset long, agent_role string, stop_reason string").withColumn(
        "event", F.lit("model_output"))
    for n in (1, 7, 300):
        expected = {}
        for t in ("t0", "t1", "t2"):
            mine = [r for r in rows if r[0] == t][-n:]
            expected[t] = sum(r[2] == "main" and r[3] == "stop" for r in mine)
        for shuffled in (df, df.repartition(7)):
            assert {r.trace: r.n_stop for r in ops.stop_count_last_n(shuffled, n).collect()} == expected
    a = sorted(ops.latest_terminal(df).collect())
    assert a == sorted(ops.latest_terminal(df.repartition(5)).collect())


def test_since_baseline(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("b", 0)], "trace string, byte_offset long")
    base = spark.createDataFrame([("a", 5)], "trace string, base_size long")
    assert sorted(tuple(r) for r in ops.since_baseline(df, base).collect()) == [("a", 10), ("b", 0)]


@pytest.mark.parametrize("split", [1, 3, 7, 64, 1 << 20])
def test_byte_ranges_cover_each_line_once(tmp_path, split):
    data = "a\n\nbb\r\nccc\rdd\n\n周报\nlast".encode()
    (tmp_path / "f.jsonl").write_bytes(data)
    [(path, size)] = list_sizes(str(tmp_path), ".jsonl").items()
    got = [x for r in split_ranges(path, 0, size, split) for x in _lines(r, False)]
    assert got == [(0, b"a"), (3, b"bb"), (7, b"ccc"), (11, b"dd"), (15, "周报".encode()), (22, b"last")]
    for offset, line in got:
        assert data[offset:offset + len(line)] == line
    assert [x for r in split_ranges(path, 0, size, split) for x in _lines(r, True)] == got[:-1]


def test_tail_from_baseline(spark, tmp_path):
    body = ('{"a":1}\n{"b":2}\n{"c":3}\n').encode()
    (tmp_path / "x.jsonl").write_bytes(body)
    (tmp_path / "skip.txt").write_bytes(body)
    name = str(tmp_path / "x.jsonl")
    read = lambda at: [(r.byte_offset, r.line) for r in read_trace_lines(
        spark, str(tmp_path), {name: at}, split_bytes=5).orderBy("byte_offset").collect()]
    assert read(0) == [(0, '{"a":1}'), (8, '{"b":2}'), (16, '{"c":3}')]
    assert read(8) == [(8, '{"b":2}'), (16, '{"c":3}')]
    assert read(10) == [(10, 'b":2}'), (16, '{"c":3}')]
    assert read(999) == []


def test_text_source_order(spark, tmp_path):
    body = "\n".join(json.dumps({"event": "model_output", "agent_role": "main", "n": i, "payload": {
        "assistant": {"stop_reason": "stop" if i % 2 else "error"}}}) for i in range(500))
    (tmp_path / "x.jsonl").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_trace_text(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        got = ops.latest_terminal(parse_events(lines), order="line_order").first()
        assert got.stop_reason == "stop"
        first = lines.groupBy("trace").agg(F.min_by("line", "line_order").alias("l")).first().l
        assert json.loads(first)["n"] == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_events(spark, tmp_path):
    rows = [("a", i, json.dumps({"timestamp": f"2026-07-0{1 + i % 2}T00:00:00Z", "session_id": "s"})) for i in range(6)]
    events = parse_events(spark.createDataFrame(rows + [("b", 0, "{}")], "trace string, byte_offset long, line string"))
    write_events(events, str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 7
    assert {str(r.event_date) for r in back.select("event_date").distinct().collect()} == {"2026-07-01", "2026-07-02", "unknown"}
    plan = back.where("event_date = '2026-07-01' and byte_offset >= 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(byte_offset,3)" in plan and "PartitionFilters: [isnotnull(event_date" in plan


def test_odd_file_names(spark, tmp_path):
    folder = tmp_path / "周 报%20"
    folder.mkdir()
    (folder / "a b.jsonl").write_text("{}\n")
    for location in (str(folder), folder.as_uri()):
        assert [(r.trace, r.line) for r in read_trace_lines(spark, location).collect()] == [(str(folder / "a b.jsonl"), "{}")]


def test_uri_of_found_files():
    assert as_uri("/a", "/a/b") == "/a/b"
    assert as_uri("hdfs://host:9000/a", "/a/b") == "hdfs://host:9000/a/b"
    assert as_uri("s3://bucket/a", "bucket/a/b") == "s3://bucket/a/b"


def test_filters_reach_the_source(spark, tmp_path):
    rng = random.Random(2)
    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_bytes("".join(
            "x" * rng.randrange(0, 9) + rng.choice(["\n", "\n", "\r", "\r\n", "\n\n"]) for _ in range(300)).encode() + b"tail")
    every = [(r.trace, r.byte_offset, r.line) for r in read_trace_lines(spark, str(tmp_path), split_bytes=64).collect()]
    b = str(tmp_path / "b.jsonl")
    size = (tmp_path / "b.jsonl").stat().st_size
    offsets = sorted({o for t, o, _ in every if t == b})
    for low in [0, 1, offsets[-1], offsets[-1] + 1, size + 5, *rng.sample(offsets, 8), *(o + 1 for o in rng.sample(offsets, 4))]:
        lines = read_trace_lines(spark, str(tmp_path), split_bytes=rng.choice([50, 100_000]))
        found = lines.where((F.col("trace") == b) & (F.col("byte_offset") >= low))
        assert sorted(map(tuple, found.collect())) == sorted(x for x in every if x[0] == b and x[1] >= low)
    low, high = offsets[50], offsets[120]
    found = lines.where((F.col("byte_offset") > low) & (F.col("byte_offset") <= high) & F.col("trace").isin(b, "none", "other"))
    assert sorted(map(tuple, found.collect())) == sorted(x for x in every if x[0] == b and low < x[1] <= high)
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = next(line for line in plan.split("\n") if "Filter" in line)
    assert "byte_offset" in kept and "trace" not in kept  # the source answers for the file alone

    reader = JsonlTailSource({"path": str(tmp_path), "splitBytes": "64"}).reader(None)
    left = list(reader.pushFilters([EqualTo(("trace",), b), GreaterThanOrEqual(("byte_offset",), size - 100), EqualTo(("line",), "x")]))
    parts = reader.partitions()
    assert [f.attribute for f in left] == [("byte_offset",), ("line",)]
    assert {p.path for p in parts} == {b} and sum(p.end - p.start for p in parts) == 100
