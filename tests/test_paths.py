import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.json_walk import _output_values, _strings
from runlens.functions.paths import (
    absolute_paths_in, clean_absolute, has_logged_extension, is_excluded_path, is_worklog_path,
    relative_paths_in, safe_relative, shell_output_fragments, workspace_path,
)
from runlens.operators.logged_paths import logged_output_paths
from runlens.operators.prefixes import below, longest_root, resolve_paths
from runlens.sources.traces import parse_events
from tests.test_text import apply


def test_predicates(spark):
    assert apply(spark, ["/a/WorkLog/x", "工作日志", "/a"], is_worklog_path) == [True, True, False]
    assert apply(spark, ["/文件输出/x", "/a"], is_excluded_path) == [True, False]
    assert apply(spark, ["a.MD", "a.html", "a.htmlx", ".md", "a.exe"], has_logged_extension) == [
        True, True, False, False, False]


def test_clean_absolute(spark):
    raw = [" `file:///r/a.md。` ", "'/r/x'", "/r/a.md)]}》", "file:///r/a.md。"]
    assert apply(spark, raw, clean_absolute) == ["/r/a.md", "/r/x", "/r/a.md", "/r/a.md"]


def test_workspace_path(spark):
    cases = {
        "./out/周报.docx": "/workspace/s1/out/周报.docx",
        "out\\a.md": "/workspace/s1/out/a.md",
        "../a.md": None, "/a.md": None, "C:\\a.md": None, "http://h/a.md": None, "a.exe": None,
        "worklog/day1": "/workspace/s1/worklog/day1",
        "'a//b/./c.txt'": "/workspace/s1/a/b/c.txt",
        "file://a.md": None, " ": None, "a/../b.md": None,
    }
    got = apply(spark, list(cases), lambda c: workspace_path(c, F.lit("s1")))
    assert got == list(cases.values())
    assert apply(spark, ["a.md"], lambda c: workspace_path(c, F.lit(""))) == [None]


def test_safe_relative(spark):
    rows = [("/r/b/../c.md", "/r", "worklog"), ("/q/x.md", "/r", ""), ("/r/a//b.md", "/r", None)]
    df = spark.createDataFrame(rows, "p string, r string, l string")
    assert [r[0] for r in df.select(safe_relative(F.col("p"), F.col("r"), F.col("l"))).collect()] == [
        "worklog/b/c.md", "x.md", "a/b.md"]


def test_shell_fragments(spark):
    command = "python x.py -o 'out/a.md' && echo hi >> b.txt; f.write_text(\"c.csv\")"
    marker = re.compile(fv.SHELL_OUTPUT_MARKER, re.I)
    expected = [command[m.end():] for m in marker.finditer(command)]
    assert len(expected) == 3
    assert apply(spark, [command, "ls", "", "a >"], shell_output_fragments) == [expected, [], [], [""]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("> -o'\"sav(e_writ=ut \n　ab")), max_size=30), min_size=1, max_size=20))
def test_shell_fragments_property(spark, commands):
    marker = re.compile(fv.SHELL_OUTPUT_MARKER, re.I)
    expected = [[c[m.end():] for m in marker.finditer(c)] for c in commands]
    assert apply(spark, commands, shell_output_fragments) == expected


PIECES = [*"ab/.-_ '\"<>`|;&，。:)\n　", "/r", ".md", ".docx", "worklog", "周报", "/r/b/"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@settings(max_examples=20, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=25))
def test_paths_in_text_property(spark, texts):
    relative = [[m.group(1) for p in fv.RELATIVE_PATH_PATTERNS for m in re.finditer(p, t, re.I)] for t in texts]
    assert apply(spark, texts, relative_paths_in) == relative
    absolute = []
    for t in texts:
        found = []
        for root in ("/r/b", "/r"):
            if t.strip() == root or t.strip().startswith(root + "/"):
                found.append(t.strip())
            pattern = re.escape(root) + rf"[^\r\n\"'<>`]*?\.(?:{fv.LOGGED_EXTENSIONS}){fv.AFTER_PATH}"
            found += [m.group(0) for m in re.finditer(pattern, t, re.I)]
        absolute.append(found)
    assert apply(spark, texts, lambda c: absolute_paths_in(c, ["/r", "/r/b"])) == absolute


def test_absolute_paths(spark):
    roots = ["/r", "/r/b"]
    texts = ["see /r/b/c.md, and \"/r/x.docx\" or /r/z.exe", "/r/b/dir only", "x /r.md"]
    got = apply(spark, texts, lambda c: absolute_paths_in(c, roots))
    assert got == [["/r/b/c.md", "/r/b/c.md", "/r/x.docx"], ["/r/b/dir only", "/r/b/dir only"], ["/r.md"]]


def test_relative_paths(spark):
    texts = ["saved 'my out/a b.md' and out/c.txt, worklog/day1", "周报.docx。", "x/y.md"]
    got = apply(spark, texts, relative_paths_in)
    assert got[0] == ["my out/a b.md", "b.md", "out/c.txt", "worklog/day1"]
    assert got[1:] == [["周报.docx"], ["x/y.md"]]


def test_json_walk():
    nested = json.dumps({"k": ["x", json.dumps({"path": "/p", "n": 1})]})
    doc = json.dumps({"a": nested, "b": {"Output_Path": "/o", "path": "/q"}, "c": ["[1"], "d": None})
    assert _strings(doc) == [nested, "x", '{"path": "/p", "n": 1}', "/p", "/o", "/q", "[1"]
    assert _output_values(doc, False) == ["/o"]
    assert _output_values(doc, True) == ["/p", "/o", "/q"]
    assert _strings("plain") == ["plain"]
    assert _strings(None) is None
    deep = "[" * 5000 + "]" * 5000
    assert _strings(json.dumps({"a": deep}))[0] == deep


def test_longest_root(spark):
    roots = spark.createDataFrame([("/r", "A"), ("/r/b/", "B")], "root_path string, root_label string")
    paths = spark.createDataFrame([(p,) for p in ["/r/b/c.md", "/r/bc.md", "/r/b", "/q/x.md", "/r", "/rx"]], "path string")
    expected = {("/r/b/c.md", "B"), ("/r/bc.md", "A"), ("/r/b", "B"), ("/r", "A")}
    got = longest_root(paths, roots).select("path", "root_label").collect()
    assert {tuple(r) for r in got} == expected and len(got) == 4
    every = longest_root(paths, roots, keep_all=True)
    assert every.count() == 6 and every.where("root_path is null").count() == 2


segment = st.sampled_from(["a", "b", "ab", ""])
path_text = st.lists(segment, min_size=1, max_size=4).map(lambda s: "/" + "/".join(s))


@settings(max_examples=10, deadline=None)
@given(st.lists(path_text, min_size=1, max_size=15), st.lists(path_text, min_size=1, max_size=6))
def test_longest_root_property(spark, paths, roots):
    table = sorted({r.rstrip("/") for r in roots})
    expected = []
    for p in paths:
        hits = [r for r in table if p == r or p.startswith(r + "/")]
        if hits:
            expected.append((p, max(hits, key=len)))
    left = spark.createDataFrame([(p,) for p in paths], "path string")
    right = spark.createDataFrame([(r, r) for r in table], "root_path string, root_label string")
    got = [tuple(r) for r in longest_root(left, right).select("path", "root_path").collect()]
    assert sorted(got) == sorted(expected)


def test_longest_root_plan_has_no_nested_loop(spark):
    roots = spark.createDataFrame([("/r", "A"), ("/r/b", "B")], "root_path string, root_label string")
    paths = spark.createDataFrame([("/r/b/c.md",)], "path string")
    plan = longest_root(paths, roots)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []


def test_resolve_paths(spark):
    listing = spark.createDataFrame(
        [("/w/worklog/d/a.md", 1, 1), ("/w/worklog/d/e/b.md", 1, 1), ("/w/worklogs/x", 1, 1), ("/w/r.md", 2, 2)],
        "path string, size long, mtime long")
    detected = spark.createDataFrame(
        [(p,) for p in ["/w/worklog/d/", "/w/r.md", "/w/none.md", "/w/文件输出/q.md", "/w/worklog/d/a.md", "/w"]],
        "remote_path string")
    matches, status = resolve_paths(detected, listing)
    assert {(r.remote_path, r.path) for r in matches.collect()} == {
        ("/w/worklog/d", "/w/worklog/d/a.md"), ("/w/worklog/d", "/w/worklog/d/e/b.md"),
        ("/w/r.md", "/w/r.md"), ("/w/worklog/d/a.md", "/w/worklog/d/a.md")}
    assert "Generate" not in matches._jdf.queryExecution().executedPlan().toString()
    assert {r.remote_path: (r.status, r.n_files) for r in status.collect()} == {
        "/w/worklog/d": ("found", 2), "/w/r.md": ("found", 1), "/w/none.md": ("not_found", 0),
        "/w/文件输出/q.md": ("ignored_internal_workspace", 0), "/w/worklog/d/a.md": ("found", 1),
        "/w": ("not_found", 0)}


def test_failed_look_ups_and_roots(spark):
    listing = spark.createDataFrame([("/w/worklog/d/a.md", 1, 1), ("/w/x.md", 1, 1)], "path string, size long, mtime long")
    detected = spark.createDataFrame([("/w/worklog/d/",), ("/w/worklog/d/a.md",), ("/w/x.md",), ("/w/文件输出",)], "remote_path string")
    failed = spark.createDataFrame([("/w/x.md", "timed out"), ("/w/文件输出", "gone"), ("/other", "no")], "path string, error string")
    roots = spark.createDataFrame([("/w/", "top"), ("/w/worklog/d/a.md", "file")], "root_path string, root_label string")
    matches, status = resolve_paths(detected, listing, roots=roots, failed=failed)
    assert {(r.remote_path, r.path, r.root_label) for r in matches.collect()} == {
        ("/w/worklog/d", "/w/worklog/d/a.md", "top"), ("/w/worklog/d/a.md", "/w/worklog/d/a.md", "file")}
    assert {(r.remote_path, r.status, r.error) for r in status.collect()} == {
        ("/w/worklog/d", "found", None), ("/w/worklog/d/a.md", "found", None), ("/w/x.md", "resolve_failed", "timed out"),
        ("/w/文件输出", "ignored_internal_workspace", None)}


odd_segment = st.sampled_from(["a", "b", "a-b", "a.b", "", "\x00", "\x01", "a\x00b", "a\x01"])
odd_path = st.lists(odd_segment, min_size=1, max_size=5).map("/".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(odd_path, max_size=25), st.lists(odd_path, max_size=10))
def test_below_property(spark, paths, roots):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, so roots stay open over borders
    table = sorted(set(roots))
    rows = [(k, p) for k, p in enumerate(paths)] + [(-1, None)]
    left = spark.createDataFrame(rows, "n long, path string")
    right = spark.createDataFrame([(r,) for r in [*table, None]], "root string")
    hits = {n: [r for r in table if p is not None and (p == r or p.startswith(r + "/"))] for n, p in rows}
    got = below(left, right, "path", "root", every=True).select("n", "root").collect()
    assert sorted(map(tuple, got)) == sorted((n, r) for n, h in hits.items() for r in h)
    got = below(left, right, "path", "root", keep_all=True).select("n", "root").collect()
    assert {r.n: r.root for r in got} == {n: max(h, key=len, default=None) for n, h in hits.items()} and len(got) == len(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_directory_with_a_third_of_all_files_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("/hot/one")).otherwise(
        F.concat(F.lit("/d"), F.col("id").cast("string"))).alias("dir"), F.col("id"))
    files = files.select("id", F.concat("dir", F.lit("/f")).alias("path"))
    roots = spark.createDataFrame([("/hot",), ("/",), ("/d5",)], "root string")
    found = below(files, roots, "path", "root", every=True).withColumn("part", F.spark_partition_id())
    hot = found.where("root = '/hot'")
    assert hot.count() == 3000 and hot.select("part").distinct().count() >= 3
    assert found.where("root = '/d5'").count() == 1 and found.where("root = '/'").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_logged_output_paths(spark):
    events = [
        {"event": "model_output", "session_id": "s1", "payload": {"assistant": {"content": [
            {"type": "text", "text": "已保存 /out/desk/a.md。 rel/ignored.md"}]}}},
        {"event": "Tool_Call", "session_id": "s1", "payload": {"tool_name": "WriteFile", "args": {
            "file": "out/b.docx", "more": json.dumps({"x": "/out/desk/sub/c.pdf"})}}},
        {"event": "tool_call", "session_id": "s1", "payload": {"tool_name": "bash", "args": {
            "command": "cat in.txt > 'res/d.txt'"}}},
        {"event": "tool_call", "session_id": "s1", "payload": {"tool_name": "read", "args": {"p": "/out/desk/no.md"}}},
        {"event": "tool_result", "session_id": "s1", "payload": {"tool_name": "read", "path": "n.md", "savedPath": "e.md"}},
        {"event": "tool_result", "session_id": "s1", "payload": {"tool_name": "save_doc", "path": "f.md"}},
        {"event": "model_output", "payload": {"assistant": "/out/desk/a.md"}},
    ]
    lines = spark.createDataFrame(
        [("t", i, json.dumps(e, ensure_ascii=False)) for i, e in enumerate(events)], "trace string, byte_offset long, line string")
    got = logged_output_paths(parse_events(lines), {"Desk": "/out/desk", "Sub": "/out/desk/sub"}).orderBy(
        "first_seen", "remote_path").collect()
    assert [(r.remote_path, r.root_label, r.first_seen) for r in got] == [
        ("/out/desk/a.md", "Desk", 0), ("/out/desk/sub/c.pdf", "Sub", 1), ("/workspace/s1/out/b.docx", "", 1),
        ("/workspace/s1/res/d.txt", "", 2), ("/workspace/s1/e.md", "", 4), ("/workspace/s1/f.md", "", 5)]
