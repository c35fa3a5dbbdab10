import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import listings as ops
from runlens.sources.listings import list_files, list_users, parse_listing, parse_log_listing, split_sections

STAT = "path string, size long, mtime long"


def test_snapshot_diff(spark):
    before = spark.createDataFrame([(p, 10, 100) for p in "abcdeg"], STAT)
    after = spark.createDataFrame(
        [("a", 10, 100), ("b", 12, 100), ("c", 10, 101), ("d", 8, 100), ("e", 8, 101), ("f", 0, 0)], STAT)
    assert [r.path for r in ops.changed_files(after, before).collect()] == ["c", "e", "b", "f"]
    kinds = {r.path: r.change_kind for r in ops.snapshot_diff(after, before).collect()}
    assert kinds == {"a": "same", "b": "grew", "c": "touched", "d": "same", "e": "touched", "f": "new"}
    tagged = ops.changed_files(after, before).withColumn("u", F.lit(1))
    assert tuple(ops.active_log(tagged, "u").first()) == (1, "c", 10, 101)


def test_new_main_log(spark):
    rows = [("u", "/x/aa.jsonl", "aa.jsonl", 5), ("u", "/x/bb.jsonl", "bb.jsonl", 3), ("u", "/x/c.jsonl", "c.jsonl", 1),
            ("u", "/x/long-old.jsonl", "long-old.jsonl", 0), ("v", "/y/o.jsonl", "o.jsonl", 1)]
    current = spark.createDataFrame(rows, "user string, path string, name string, created long").withColumn(
        "size", F.lit(9)).withColumn("mtime", F.lit(9))
    before = spark.createDataFrame([("/x/long-old.jsonl", 9, 9), ("/y/o.jsonl", 1, 9)], STAT)
    assert [tuple(r) for r in ops.new_main_log(current, before, "user").collect()] == [("u", "/x/bb.jsonl", 3)]
    watched = {r.user: (r.path, r.origin) for r in ops.watched_log(current, before, "user").collect()}
    assert watched == {"u": ("/x/bb.jsonl", "new"), "v": ("/y/o.jsonl", "changed")}


def test_parse_listing(spark):
    lines = ["  10|20|/a|b.md\t", "10|x|/a", "10|20", "", "1.5|2|/c", "+3|4|/d", "5|6|"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted(tuple(r) for r in parse_listing(df).collect()) == [("", 6, 5), ("/a|b.md", 20, 10), ("/d", 4, 3)]


def test_parse_log_listing(spark):
    rows = [("a", 1, "5 7 /l/x y.jsonl"), ("a", 2, "5 7 /l/x.txt"), ("a", 3, " __END__ "), ("a", 4, "5 7 /l/late.jsonl"),
            ("b", 1, "5 7 /l/z.jsonl")]
    df = spark.createDataFrame(rows, "block string, line_no int, line string")
    assert [tuple(r) for r in parse_log_listing(df).collect()] == [("a", "/l/x y.jsonl", 7, 5, "x y.jsonl")]


def test_split_sections(spark):
    good = ["1|1|r", "__WORKLOG__", "1|1|w", "1|1|w2", "__SUMMARY__", "1|1|s", "__END__", "1|1|late"]
    rows = [("p", i, x) for i, x in enumerate(good)] + [("q", 0, "1|1|r"), ("q", 1, "__WORKLOG__"), ("q", 2, "__END__")]
    rows += [("o", 0, "__SUMMARY__"), ("o", 1, "__WORKLOG__")]
    sectioned, broken = split_sections(spark.createDataFrame(rows, "payload_id string, line_no int, line string"))
    got = parse_listing(sectioned.drop("line_no")).orderBy("path").collect()
    assert [(r.section, r.path) for r in got] == [("report", "r"), ("summary", "s"), ("worklog", "w"), ("worklog", "w2")]
    assert sorted(r.payload_id for r in broken.collect()) == ["o", "q"]


def test_list_users(spark):
    df = spark.createDataFrame([(x,) for x in [" b ", "a", "a", ".", "..", "x/y", "", "　"]], "name string")
    assert [r.user_id for r in list_users(df).collect()] == ["a", "b"]


def test_list_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"123")
    (tmp_path / "sub" / "b.md").write_bytes(b"")
    deep = {r.path.rsplit("/", 1)[1]: r["size"] for r in list_files(spark, str(tmp_path)).collect()}
    assert deep == {"a.md": 3, "b.md": 0}
    assert list_files(spark, str(tmp_path), recursive=False).count() == 1
    for i in range(600):
        (tmp_path / "sub" / f"d{i}").mkdir()
        (tmp_path / "sub" / f"d{i}" / "f").touch()
    assert list_files(spark, str(tmp_path)).select("path").distinct().count() == 602
    assert list_files(spark, str(tmp_path / "none")).count() == 0


def test_signature(spark):
    a = [("s", 1, "/a", 1, 1), ("s", 1, "/b", 2, 2), ("s", 2, "/b", 2, 2), ("s", 2, "/a", 1, 1), ("s", 3, "/a", 1, 2), ("s", 3, "/b", 2, 2)]
    df = spark.createDataFrame(a, "s string, poll int, path string, size long, mtime long")
    sig = {r.poll: r.signature for r in ops.listing_signature(df, ["s", "poll"]).collect()}
    assert sig[1] == sig[2] != sig[3]


def reference_runs(polls):
    """Plain loop over one session's polls: (poll, signature, present) -> run per poll."""
    run, last, out = 0, None, {}
    for poll, sig, present in sorted(polls):
        run = (run + 1 if run and sig == last else 1) if present else 0
        last = sig
        out[poll] = run
    return out


def test_stability_golden(spark):
    rows = [("s", 1, "x", False), ("s", 2, "y", True), ("s", 3, "z", True), ("s", 4, "z", True), ("t", 1, "a", True)]
    df = spark.createDataFrame(rows, "session_id string, poll_no long, signature string, present boolean")
    runs = ops.stability_runs(df)
    assert [r.run for r in runs.where("session_id='s'").orderBy("poll_no").collect()] == [0, 1, 1, 2]
    first = {r.session_id: (r.poll_no, r.stable) for r in ops.first_stable_poll(runs, 2).collect()}
    assert first == {"s": (4, True), "t": (1, False)}


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 3, 7, 4096]))
def test_stability_property(spark, seed, bucket):
    rng = random.Random(seed)
    rows = []
    for s in "abc":
        polls = sorted(rng.sample(range(60), rng.randint(1, 40)))
        rows += [(s, p, rng.choice(["x", "x", "x", "y"]), rng.random() < 0.85) for p in polls]
    df = spark.createDataFrame(rows, "session_id string, poll_no long, signature string, present boolean")
    got = {(r.session_id, r.poll_no): r.run for r in ops.stability_runs(df, bucket_polls=bucket).collect()}
    want = {(s, p): n for s in "abc" for p, n in reference_runs([r[1:] for r in rows if r[0] == s]).items()}
    assert got == want


def test_poll_states(spark):
    files = [("s", 1, "report", "/a.docx", 1, 1), ("s", 1, "worklog", "/w.md", 1, 1), ("s", 2, "report", "/a.docx", 1, 1),
             ("s", 2, "report", "/a.htm", 1, 1), ("s", 3, "report", "/a.htm", 1, 1), ("s", 3, "report", "/a.docx", 1, 1), ("t", 1, "summary", "/s.md", 1, 1)]
    df = spark.createDataFrame(files, "session_id string, poll_no long, source string, path string, size long, mtime long")
    polls = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 1), ("t", 2)], "session_id string, poll_no long")
    required = spark.createDataFrame([("s", ["docx", "html"])], "session_id string, required array<string>")
    got = {(r.session_id, r.poll_no): r for r in ops.poll_states(polls, df, required).collect()}
    assert {k: r.present for k, r in got.items()} == {("s", 1): False, ("s", 2): True, ("s", 3): True, ("t", 1): False, ("t", 2): False}
    assert got["s", 2].signature == got["s", 3].signature != got["s", 1].signature and got["t", 2].n_files == 0
    some = {(r.session_id, r.poll_no) for r in ops.poll_states(polls, df, None, require_worklog=True).where("present").collect()}
    assert some == {("s", 1)}


def test_session_artifacts(spark):
    w = "/workspace"
    paths = [f"{w}/s1/a.docx", f"{w}/s1/b.htm", f"{w}/s1/deep/c.md", f"{w}/s2/a.md", f"{w}/s9/a.md",
             f"{w}/memory/weekly-work-report/worklog/d/1.md", f"{w}/memory/weekly-work-report/summary/2.md", "/x/s1/a.md"]
    listing = spark.createDataFrame([("dev", p, 1, 1) for p in paths], "device string, " + STAT)
    sessions = spark.createDataFrame([("dev", "s1"), ("dev", "s2"), ("dev", "s3"), ("other", "s1")], "device string, session_id string")
    rows, counts = ops.session_artifacts(listing, sessions, "device")
    assert sorted((r.session_id or "-", r.source) for r in rows.collect()) == [
        ("-", "summary"), ("-", "worklog"), ("s1", "report"), ("s1", "report"), ("s2", "report")]
    got = {(r.device, r.session_id): (r.n_reports, r.report_formats, r.n_worklogs, r.n_summaries) for r in counts.collect()}
    assert got == {("dev", "s1"): (2, ["docx", "html"], 1, 1), ("dev", "s2"): (1, ["md"], 1, 1),
                   ("dev", "s3"): (0, [], 1, 1), ("other", "s1"): (0, [], 0, 0)}


@pytest.mark.parametrize("field", ["size", "mtime"])
def test_diff_keeps_columns(spark, field):
    df = spark.createDataFrame([("a", 1, 1)], STAT)
    assert field in ops.snapshot_diff(df, df).columns


def test_polls_without_a_place_keep_their_row(spark):
    rows = [("s", 1, "x", True), ("s", 2, "x", True), (None, 1, "x", True), ("s", None, "y", None), ("s", 3, "x", True), ("t", None, "z", True)]
    polls = spark.createDataFrame(rows, "session_id string, poll_no long, signature string, present boolean")
    runs = ops.stability_runs(polls)
    assert sorted((r.session_id or "", r.poll_no or 0, r.present, r.run) for r in runs.collect()) == [
        ("", 1, True, 0), ("s", 0, False, 0), ("s", 1, True, 1), ("s", 2, True, 2), ("s", 3, True, 3), ("t", 0, True, 0)]
    assert {(r.session_id, r.poll_no, r.stable) for r in ops.first_stable_poll(runs, 3).collect()} == {("s", 3, True), ("t", None, False)}


def test_files_are_placed_once_per_scan(spark):
    made = spark.range(4).select(F.col("id").alias("case_id"), F.concat(F.lit("/workspace/s"), F.col("id"), F.lit("/a.pdf")).alias("path"))
    sessions = spark.createDataFrame([(k, f"s{k}") for k in range(3)], "case_id long, session_id string")
    rows, _ = ops.session_artifacts(made, sessions, "case_id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("worklog/") <= 2
    assert sorted((r.case_id, r.source, r.session_id) for r in rows.collect()) == [(k, "report", f"s{k}") for k in range(3)]
