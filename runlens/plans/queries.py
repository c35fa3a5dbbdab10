"""One query per operator over the provided tables; each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import ids, json_walk, paths, text
from runlens.functions.text import ReplyRules
from runlens.operators.common import exploded
from runlens.operators import chain, listings, logged_paths, prefixes, runs, tasks, traces
from runlens.plans import views as v
from runlens.session import checkpoint_folder
from runlens.sources import listings as listing_source
from runlens.sources import meta_store
from runlens.sources import traces as trace_source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c: str | Column) -> Column:
    """Array of strings as one string, null-safe."""
    return F.coalesce(F.array_join(c, ","), F.lit(""))


# --- traces ---------------------------------------------------------------------------------------

@query
def trace_scan(spark, sf):
    """JSONL lines to events: what survives of each trace."""
    events = trace_source.parse_events(v.event_lines(spark, sf), keep_malformed=True)
    return events.groupBy("trace").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if("malformed").alias("n_malformed"),
        F.count_if(F.col("agent_role") == "main").alias("n_main"),
        F.count_if(F.col("stop_reason") == "stop").alias("n_stop"),
        F.count_if(F.col("event") == "tool_call").alias("n_tool_calls"),
        F.min("timestamp").alias("first_timestamp"),
    )


@query
def trace_terminal(spark, sf):
    return traces.latest_terminal(v.trace_events(spark, sf)).select("trace", "stop_reason")


@query
def trace_has_stop(spark, sf):
    return traces.latest_terminal(v.trace_events(spark, sf)).select("trace", "has_stop")


@query
def trace_terminal_raw(spark, sf):
    """The same from raw lines: prefilter, parse, aggregate."""
    lines = trace_source.terminal_candidates(v.event_lines(spark, sf), keep_rows=True)
    return traces.latest_terminal(trace_source.parse_events(lines, keep_malformed=True)).select("trace", "stop_reason")


@query
def trace_recent_terminal(spark, sf):
    return traces.recent_terminal(v.trace_events(spark, sf), n=3).select("trace", "stop_reason")


@query
def trace_last_reply(spark, sf):
    return traces.last_reply(trace_source.parse_events(v.reply_lines(spark, sf)))


@query
def trace_main_session(spark, sf):
    return traces.main_session(v.trace_events(spark, sf))


@query
def trace_stop_count_last_n(spark, sf):
    return traces.stop_count_last_n(v.trace_events(spark, sf), n=20)


@query
def trace_created(spark, sf):
    lines = trace_source.parse_events(v.event_lines(spark, sf), keep_malformed=True)
    mtimes = v.snapshot(spark, sf).select(F.col("user_id").alias("trace"), "mtime")
    return traces.created_time(lines, mtimes).select("trace", F.unix_micros("created").alias("created_us"))


@query
def trace_since_baseline(spark, sf):
    events = v.trace_events(spark, sf)
    known = F.col("trace") + F.when(v.mod("trace", 10, 0), 1_000_000_000).otherwise(0)
    base = events.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy(known.alias("trace")).agg(
        (F.max("byte_offset") + 1).alias("base_size"))
    later = traces.since_baseline(events, base)
    ends = traces.latest_terminal(later)
    counts = later.groupBy("trace").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.join(ends, "trace").select("trace", "n_events", "stop_reason")


@query
def trace_outcome_timeout(spark, sf):
    answers = traces.outcome_with_timeout(v.trace_events(spark, sf), timeout_seconds=86400)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c + "_us")
    return answers.select("trace", "outcome", us("started"), us("ended"))


@query
def trace_summary(spark, sf):
    return traces.trace_summary(v.trace_events(spark, sf), timeout_seconds=86400).select(
        "trace", "outcome", "latest_reason", "session_id")


# --- listings -------------------------------------------------------------------------------------

@query
def listing_parse(spark, sf):
    return listing_source.parse_listing(v.listing_lines(spark, sf, "|").select("line"))


@query
def log_listing_parse(spark, sf):
    return listing_source.parse_log_listing(v.log_blocks(spark, sf)).select("block", "path", "name", "size", "mtime")


@query
def listing_sections(spark, sf):
    sectioned, broken = listing_source.split_sections(v.section_lines(spark, sf))
    files = listing_source.parse_listing(sectioned.select("payload_id", "section", "line"))
    return files.groupBy("payload_id", "section").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes")
    ).unionByName(broken.select(
        "payload_id", F.col("problem").alias("section"), F.lit(0).cast("bigint").alias("n_files"),
        F.lit(0).cast("bigint").alias("bytes")))


@query
def listing_users(spark, sf):
    user = v.text_of("user_id")
    name = (
        F.when(v.mod("event_id", 50, 0), "..").when(v.mod("event_id", 51, 0), F.concat(user, F.lit("/x")))
        .when(v.mod("event_id", 52, 0), " \t").otherwise(F.concat(F.lit(" u"), user, F.lit("　")))
    )
    return listing_source.list_users(v.table(spark, sf, "events").select(name.alias("name")))


@query
def prompt_quality(spark, sf):
    raw = F.encode("text", "UTF-8")
    kind = v.mod("doc_id", 7)
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when(kind == 1, F.encode(F.lit(" \n　"), "UTF-8"))
        .when(kind == 2, F.concat(raw, F.unhex(F.lit("00"))))
        .when(kind == 3, F.concat(raw, F.unhex(F.lit("C3"))))
        .otherwise(raw)
    )
    docs = v.table(spark, sf, "documents").select("doc_id", content.alias("content"))
    problem = text.prompt_problem(F.col("content"))
    return docs.select(
        "doc_id", problem.alias("problem"),
        F.when(problem.isNull(), F.length(text.prompt_text(F.col("content")))).cast("bigint").alias("n_chars"),
    )


@query
def snapshot_diff(spark, sf):
    current = v.snapshot(spark, sf).select("path", "size", "mtime")
    return listings.snapshot_diff(current, v.baseline(spark, sf)).select("path", "size", "mtime", "change_kind")


@query
def snapshot_active(spark, sf):
    current = v.snapshot(spark, sf).withColumn("device", v.mod("user_id", 10)).select("device", "path", "size", "mtime")
    return listings.active_log(listings.changed_files(current, v.baseline(spark, sf)), "device")


@query
def snapshot_new_main(spark, sf):
    current = v.snapshot(spark, sf).withColumn("device", v.mod("user_id", 10))
    before = v.baseline(spark, sf).where(F.col("size") < 1_000_000)
    return listings.new_main_log(current, before, "device")


@query
def snapshot_watched(spark, sf):
    current = v.snapshot(spark, sf).withColumn("device", v.mod("user_id", 40))
    return listings.watched_log(current, v.baseline(spark, sf), "device")


def same_as(states: DataFrame, key: str, no: str) -> DataFrame:
    """First poll of the session that showed the same listing, in place of the fingerprint itself."""
    first = states.groupBy(key, "n_files", "signature").agg(F.min(no).alias("same_as"))
    return states.join(first, [key, "n_files", "signature"]).drop("signature")


@query
def listing_signature(spark, sf):
    """A listing per user and day, of few distinct files so that days repeat each other."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    files = v.table(spark, sf, "events").select(
        "user_id", day.alias("day"), F.concat(F.lit("/f"), F.col("event_type")).alias("path"),
        (F.col("event_id") % 2).alias("size"), F.lit(7).alias("mtime")).distinct()
    return same_as(listings.listing_signature(files, ["user_id", "day"]), "user_id", "day")


@query
def poll_states(spark, sf):
    """A poll per customer and month of orders; the files of a poll are the orders' line items."""
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint")
    order = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), month.alias("poll_no"), F.col("o_orderkey").alias("case_id"))
    files = v.artifacts(spark, sf).join(order, "case_id").select(
        "session_id", "poll_no", "source", "path", "size", F.lit(0).alias("mtime"))
    required = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("session_id"),
        F.when(v.mod("c_custkey", 3, 0), F.array(F.lit("docx"), F.lit("html"))).alias("required"))
    states = listings.poll_states(order, files, required, require_worklog=True)
    return states.select("session_id", "poll_no", "n_files", "present")


@query
def stability_runs(spark, sf):
    return listings.stability_runs(_polls_and_loose_ones(spark, sf), bucket_polls=8)


@query
def stability_first(spark, sf):
    return listings.first_stable_poll(listings.stability_runs(_polls_and_loose_ones(spark, sf), bucket_polls=8), checks=2)


def _polls_and_loose_ones(spark, sf):
    """All polls, each also without its session or without its number, whichever its day says; users 0 to 9 only so."""
    polls = v.polls(spark, sf)
    session = F.when(v.mod("poll_no", 2, 0), F.col("session_id"))
    loose = polls.select(session.alias("session_id"), F.when(session.isNull(), F.col("poll_no")).alias("poll_no"), "signature", "present")
    return polls.where("session_id >= 10").unionAll(loose)


@query
def session_artifacts(spark, sf):
    """Files of sessions: a session per page, reports beside nested files, shared logs per host."""
    p = v.page_paths(spark, sf)
    host = F.split("path", "/")[1]
    session = F.concat(F.lit("s"), v.text_of(v.mod("page_id", 60)))
    page = v.text_of("page_id")
    kinds = F.explode(F.array(
        F.concat(F.lit("/workspace/"), session, F.lit("/r"), page, v.pick(v.mod("page_id", 3), [".docx", ".htm", ".MD"])),
        F.concat(F.lit("/workspace/"), session, F.lit("/deep/r"), page, F.lit(".pdf")),
        F.concat(F.lit("/workspace/memory/weekly-work-report/worklog/"), page, F.lit("/w.md")),
        F.concat(F.lit("/workspace/memory/weekly-work-report/summary/"), page, F.lit(".md")),
        F.concat(F.lit("/elsewhere/"), session, F.lit("/x.md")),
    ))
    files = p.select(host.alias("device"), kinds.alias("path"), F.lit(1).alias("size"))
    asked = F.when(v.mod("page_id", 5, 0), F.concat(F.lit("none"), page)).otherwise(session)
    sessions = p.select(host.alias("device"), asked.alias("session_id"))
    _, counts = listings.session_artifacts(files, sessions, "device")
    return counts.withColumn("report_formats", joined("report_formats"))


@query
def session_artifact_rows(spark, sf):
    """Artifact rows by source, from one union of reports, work logs and summaries."""
    files = v.artifacts(spark, sf).select("case_id", "path", F.col("source").alias("kind"))
    part = lambda k: files.where(F.col("kind") == k).drop("kind")
    rows = listings.union_sources(part("report"), part("worklog"), part("summary"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("case_id").alias("n_cases"))


# --- paths ----------------------------------------------------------------------------------------

@query
def longest_root(spark, sf):
    return prefixes.longest_root(v.page_paths(spark, sf), v.page_roots(spark, sf))


@query
def resolve_paths(spark, sf):
    """Status of the paths that pages claim, against a listing in which a third of them moved."""
    _, status = _resolved(spark, sf)
    return status


@query
def resolve_path_matches(spark, sf):
    matches, _ = _resolved(spark, sf)
    return matches.select("remote_path", "path", "size", "root_label")


def _resolved(spark, sf):
    p = v.page_paths(spark, sf)
    n = F.col("page_id")
    host = F.concat(F.lit("/"), F.split("path", "/")[1])
    listing = p.select(
        F.when(v.mod("page_id", 3, 0), F.concat(F.lit("/moved"), F.col("path")))
        .when(v.mod("page_id", 4, 1), F.concat(host, F.lit("/worklog/"), v.text_of("page_id"), F.lit(".md")))
        .otherwise(F.concat(F.regexp_replace("path", "/$", ""), F.lit("/f"))).alias("path"),
        n.alias("size"), n.alias("mtime"))
    claimed = F.when(v.mod("page_id", 5, 0), F.concat(host, F.lit("/worklog/"))).when(
        v.mod("page_id", 7, 0), F.concat(host, F.lit("/文件输出/x"))).otherwise(
        F.concat(F.regexp_replace("path", "/$", ""), F.lit("/f")))
    claims = p.select(claimed.alias("remote_path"))
    failed = claims.where(F.length("remote_path") % 11 == 0).select(F.col("remote_path").alias("path"), F.lit("timed out").alias("error"))
    return prefixes.resolve_paths(claims, listing, roots=v.page_roots(spark, sf), failed=failed)


@query
def safe_relative(spark, sf):
    p = v.page_paths(spark, sf)
    root = F.concat(F.lit("/"), F.split("path", "/")[1])
    dotted = F.when(v.mod("page_id", 4, 0), F.concat(F.col("path"), F.lit("/.././/x.md"))).otherwise(F.col("path"))
    other = F.when(v.mod("page_id", 6, 0), F.lit("/none")).otherwise(root)
    label = v.pick(v.mod("page_id", 3), ["", "worklog", "summary"])
    return p.select("page_id", paths.safe_relative(dotted, other, label).alias("relative"))


def _logged_path() -> Column:
    before = v.pick(v.mod("page_id", 10), [
        "./out/", "out\\", "../", "/abs/", "C:\\", "http://h/", "`worklog/", "file://", " 'a//./b/", "x/../"])
    after = v.pick(v.mod("page_id", 7), [".md", ".docx，", ".exe", "", ".html'", ".PDF)", ".csv。 "])
    return F.concat(before, v.text_of("page_id"), after)


@query
def workspace_path(spark, sf):
    session = F.when(v.mod("page_id", 13, 0), "").otherwise(F.concat(F.lit("s"), v.text_of(v.mod("page_id", 9))))
    return v.page_paths(spark, sf).select("page_id", paths.workspace_path(_logged_path(), session).alias("remote_path"))


@query
def path_flags(spark, sf):
    logged = _logged_path()
    clean = paths.clean_absolute(logged)
    spelled = F.concat(clean, v.pick(v.mod("page_id", 4), ["", "/文件输出/a.txt", "/Work_Log/b", "/工作日志"]))
    return v.page_paths(spark, sf).select(
        "page_id", clean.alias("clean"),
        paths.is_worklog_path(spelled).alias("is_worklog"),
        paths.has_logged_extension(spelled).alias("has_extension"),
        paths.is_excluded_path(spelled).alias("is_excluded"),
    )


@query
def url_path_flags(spark, sf):
    """The path rules on the addresses of real pages, as a text would quote them."""
    ends = v.pick(v.mod("page_id", 5), ["", "。", "/Work-Log/x.MD).", "/工作快捷区/a.jsonl`", "/b.HTML?!"])
    clean = paths.clean_absolute(F.concat(F.lit(" \"file://"), "url", ends, F.lit("' ")))
    return v.table(spark, sf, "pages").select(
        "page_id", clean.alias("clean"), paths.is_worklog_path(clean).alias("is_worklog"),
        paths.has_logged_extension(clean).alias("has_extension"), paths.is_excluded_path(clean).alias("is_excluded"))


@query
def root_paths(spark, sf):
    """Absolute paths that sentences about pages mention."""
    found = paths.absolute_paths_in(_sentence(), ["/out/desk", "/out/desk/sub"])
    return exploded(v.page_paths(spark, sf), ["page_id"], found, "found")


@query
def relative_paths(spark, sf):
    found = exploded(v.page_paths(spark, sf), ["page_id"], paths.relative_paths_in(_sentence()), "found", "pos")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


def _sentence() -> Column:
    page = v.text_of("page_id")
    whole = F.concat(F.lit(" /out/desk/sub/"), page, F.lit(" "))
    mixed = F.concat(
        F.lit("saved /out/desk/"), page, F.lit(".md, then 'my dir/"), page, F.lit(".docx'。 See /out/desk/sub/n"), page,
        F.lit(".exe; res/"), page, F.lit(".csv"))
    quoted = F.concat(F.lit("\"/out/desk/sub/"), page, F.lit(".html\" and \"worklog/"), page, F.lit("\""))
    return F.when(v.mod("page_id", 3, 0), whole).when(v.mod("page_id", 3, 1), mixed).otherwise(quoted)


# --- tasks ----------------------------------------------------------------------------------------

@query
def target_list(spark, sf):
    turns = v.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("value"))
    return tasks.normalize_targets(turns, "conv_id").withColumn("item_pos", F.col("item_pos").cast("bigint"))


@query
def id_validation(spark, sf):
    t = v.tasks(spark, sf)
    session = F.concat(F.col("absolute_id"), v.pick(v.mod("task_no", 5), ["", "/x", "..", " ", "\\y"]))
    return t.select(
        "task_no", ids.id_problem(F.col("absolute_id")).alias("id_problem"),
        ids.session_id_problem(session).alias("session_problem"))


@query
def registry_report(spark, sf):
    unreadable = F.when(v.mod("task_no", 71, 0), "invalid-json")
    return tasks.registry_report(v.tasks(spark, sf).withColumn("problem", unreadable))


@query
def registry_order(spark, sf):
    t = v.tasks(spark, sf).select(F.col("absolute_id").alias("task_id"), "person", "task_no")
    return tasks.registry_ordinals(t, ties=["task_no"]).select(
        "ordinal", "task_no", "person", F.col("sort_key.kind").alias("kind"),
        F.col("sort_key.digits").cast("bigint").alias("digits"), F.col("sort_key.text").alias("key_text"))


@query
def tasks_by_person(spark, sf):
    t = v.tasks(spark, sf).select(F.col("absolute_id").alias("task_id"), "person")
    return tasks.tasks_by_person(t).select("person", "task_id", "first_task_id", "n_tasks")


@query
def target_resolution(spark, sf):
    return tasks.resolve_targets(v.target_codes(spark, sf), v.tasks(spark, sf)).select(
        "target", "person", "n_matches", "status", "task_id")


@query
def task_targets(spark, sf):
    known = F.when(v.mod("n_nationkey", 6, 0), "NOBODY").otherwise(F.col("n_name"))
    prefixes_dim = v.table(spark, sf, "nation").select(known.alias("person"), F.concat(F.lit("n"), v.text_of("n_nationkey"), F.lit("w")).alias("prefix"))
    return tasks.assign_targets(v.tasks(spark, sf), prefixes_dim).select("task_no", "target", "target_problem")


@query
def select_tasks(spark, sf):
    t = v.simple_tasks(spark, sf).select(F.col("case_id").alias("task_id"), "person")
    wanted = v.table(spark, sf, "orders").where(F.col("o_totalprice") > 300000).select(
        (F.col("o_custkey") + F.when(v.mod("o_orderkey", 100, 0), 10_000_000).otherwise(0)).alias("task_id"))
    people = v.table(spark, sf, "nation").where(F.col("n_regionkey") < 2).select(F.col("n_name").alias("person"))
    kept, unknown = tasks.select_tasks(t, wanted, people)
    return kept.select("task_id", F.lit("selected").alias("status")).unionByName(
        unknown.select("task_id", F.lit("unknown").alias("status")))


@query
def pending_tasks(spark, sf):
    t = v.simple_tasks(spark, sf)
    return tasks.pending_tasks(t, v.ledger(spark, sf, moved=True), task_id="case_id")


@query
def prompt_build(spark, sf):
    suffix = v.pick(v.mod("doc_id", 4), ["", " Please.\n", ".", None])
    prompt = text.execution_prompt(F.concat(F.col("text"), F.lit("　\n ")), suffix)
    return v.table(spark, sf, "documents").select(
        "doc_id", F.md5(prompt.cast("binary")).alias("prompt_md5"), F.length(prompt).cast("bigint").alias("n_chars"))


@query
def batch_next_version(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.date_format("o_orderdate", "yyyyMMdd").alias("run_date"))
    used = orders.where(F.month("o_orderdate") != 6).select("run_date", (1 + F.col("o_custkey") % 60).alias("version"))
    bad = v.table(spark, sf, "orders").select(F.lit("20241399").alias("run_date"), F.lit(1).cast("bigint").alias("version"))
    free = tasks.next_batch_version(used.unionByName(bad), orders)
    return free.select("mmdd", "n_used", "next_version", tasks.batch_name(F.col("mmdd"), F.col("next_version")).alias("name"))


# --- text rules -----------------------------------------------------------------------------------

WORD_RULES = ReplyRules(
    failure=(r"\bthat\b.{0,12}\bare\b", r"\baux\b.{0,3}\bun\b"),
    completion=(r"\bthe\b.{0,24}\bof\b", r"\bder\b.{0,12}\bdie\b"),
    courtesy=(r"\band\b.{0,20}\bin\b",),
    confirmation=(r"\bla\b", r"\bwas\b.{0,8}\bon\b"),
    future_only=(r"\bdes\b", r"\bles?\b"),
)


@query
def reply_verdict(spark, sf):
    docs = v.table(spark, sf, "documents")
    body = F.when(v.mod("doc_id", 50, 0), F.lit(" 　\n")).otherwise(F.col("text"))
    return docs.select("doc_id", text.reply_verdict(body, WORD_RULES).alias("verdict"))


REPLY_ENDINGS = [
    "周报已生成", "无法生成周报", "周报已生成，但无法保存文件", "周报已生成，还有其他需要帮忙的吗？",
    "是否继续生成周报？", "worklog 已保存，是否继续生成 PDF？", "接下来将整理数据", "", "请稍后确认", "生成\n失败",
]


@query
def reply_verdict_default(spark, sf):
    """The default rules, on turns that end in a fixed sentence."""
    body = F.concat("text", F.lit("\n"), v.pick((F.col("conv_id") + F.col("turn")) % 10, REPLY_ENDINGS))
    return v.table(spark, sf, "conversations").select("conv_id", "turn", text.reply_verdict(body).alias("verdict"))


@query
def rule_hits(spark, sf):
    hits = exploded(v.table(spark, sf, "documents"), ["lang"], text.rules_hit(F.col("text"), WORD_RULES), "h")
    return hits.groupBy("lang", "h.rule_group", "h.rule_no").agg(
        F.count(F.lit(1)).alias("n_docs"))


@query
def required_formats(spark, sf):
    body = F.concat("text", F.lit(" "), v.pick(v.mod("doc_id", 9), v.FORMAT_TEXTS))
    return v.table(spark, sf, "documents").select("doc_id", joined(text.requested_formats(body)).alias("formats"))


# --- JSON and commands ----------------------------------------------------------------------------

def _documents(spark, sf) -> DataFrame:
    """A JSON document per turn, with JSON inside a string inside JSON."""
    inner = F.to_json(F.struct(
        F.concat(F.lit("/p/"), v.text_of("turn"), F.lit(".md")).alias("path"),
        F.struct(F.concat(F.lit("/o/"), v.text_of("conv_id")).alias("Output_Dir"), F.col("turn").alias("n")).alias("more"),
    ))
    doc = F.to_json(F.struct(
        F.array(F.col("role"), F.concat(F.lit("t "), F.col("text"))).alias("items"),
        inner.alias("raw"),
        F.struct(F.concat(F.lit("/s/"), v.text_of("turn")).alias("savedPath"), F.col("role").alias("kind")).alias("out"),
        F.col("turn").alias("n"),
    ))
    return v.table(spark, sf, "conversations").select("conv_id", "turn", doc.alias("doc"))


@query
def json_strings(spark, sf):
    found = _documents(spark, sf).select(
        "conv_id", "turn", F.posexplode(json_walk.json_strings(F.col("doc"))).alias("pos", "value"))
    return found.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "value")


@query
def json_output_keys(spark, sf):
    found = json_walk.json_output_values(F.col("doc"), F.col("turn") % 2 == 0)
    return _documents(spark, sf).select("conv_id", "turn", F.posexplode(found).alias("pos", "value")).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "value")


def _command() -> Column:
    n = v.text_of("event_id")
    return F.concat(v.pick(v.mod("event_id", 6), [
        "ls -la ", "cat a > 'b", "python x.py --output=", "cc  -O2 -o  ", "f.save_as (\"", "echo x >> w.write_text('"]),
        n, F.lit(".txt"), v.pick(v.mod("event_id", 4), ["", " && tee > log", "') --out z", " -o\ty"]))


@query
def shell_fragments(spark, sf):
    found = paths.shell_output_fragments(_command())
    return exploded(v.table(spark, sf, "events"), ["event_id"], found, "fragment", "pos").select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), "fragment")


def _with_mention(text: Column, mention: Column) -> Column:
    """A real text with a mention in its middle."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), half), mention, F.substr(text, half + 1, F.char_length(text)))


def _documents_with_paths(spark, sf) -> DataFrame:
    """documents; each whole text also mentions a file or a work log, written in one of seven ways."""
    n = v.text_of("doc_id")
    before = v.pick(v.mod("doc_id", 7), [" './my out/", " res/", " 'my dir\\", " ../up/", " C:/x/", " notes/worklog/", " saved /out/desk/sub/"])
    after = v.pick(v.mod("doc_id", 7), [".docx' ", ".CSV, ", ".md'; ", ".pdf; ", ".txt ", " ", ".html] and /out/desk/b.log "])
    return v.table(spark, sf, "documents").select("doc_id", _with_mention(F.col("text"), F.concat(before, n, after)).alias("text"))


@query
def text_relative_paths(spark, sf):
    """Relative paths that whole documents mention, in the order of the patterns."""
    found = exploded(_documents_with_paths(spark, sf), ["doc_id"], paths.relative_paths_in(F.col("text")), "found", "pos")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query
def text_root_paths(spark, sf):
    """Absolute paths below known roots that whole documents mention."""
    return exploded(
        _documents_with_paths(spark, sf), ["doc_id"], paths.absolute_paths_in(F.col("text"), ["/out/desk", "/out/desk/sub"]), "found")


@query
def text_workspace_paths(spark, sf):
    """Where the relative paths that documents mention lie in the workspace of a session; refused ones are null."""
    session = F.when(v.mod("doc_id", 13, 0), "").otherwise(F.concat(F.lit("s"), v.text_of(v.mod("doc_id", 9))))
    found = exploded(_documents_with_paths(spark, sf), ["doc_id"], paths.relative_paths_in(F.col("text")), "found")
    return found.select("doc_id", "found", paths.workspace_path(F.col("found"), session).alias("remote_path"))


@query
def text_shell_fragments(spark, sf):
    """Output targets of commands that quote whole turns of conversations."""
    n = F.concat(v.text_of("conv_id"), F.lit("-"), v.text_of("turn"))
    kind = v.mod(F.col("conv_id") + F.col("turn"), 5)
    mention = F.concat(v.pick(kind, [" > '", " --output=", " -o  ", " f.save_as( \"", " >>log; g.write ('"]), n, F.lit(".txt "))
    found = paths.shell_output_fragments(_with_mention(F.col("text"), mention))
    rows = exploded(v.table(spark, sf, "conversations"), ["conv_id", "turn"], found, "fragment", "pos")
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "fragment")


@query
def logged_paths_found(spark, sf):
    """Output paths of traces whose turns are replies, write calls, shell calls and tool results."""
    n = F.concat(v.text_of("conv_id"), F.lit("-"), v.text_of("turn"))
    kind = v.mod("turn", 4)
    args = F.struct(
        F.when(kind == 1, F.concat(F.lit("out/"), v.text_of("conv_id"), F.lit(".docx"))).alias("file"),
        F.when(kind == 2, F.concat(F.lit("cat x > 'res/"), n, F.lit(".csv'"))).alias("command"))
    line = F.to_json(F.struct(
        v.pick(kind, ["model_output", "tool_call", "Tool_Call", "tool_result"]).alias("event"),
        F.concat(F.lit("s"), v.text_of("conv_id")).alias("session_id"),
        F.struct(
            F.when(kind == 0, F.struct(F.array(F.struct(
                F.lit("text").alias("type"), F.concat(F.col("text"), F.lit("\n/desk/"), n, F.lit(".md。 no/rel.md")).alias("text")
            )).alias("content"))).alias("assistant"),
            v.pick(kind, [None, "WriteFile", "bash", "read"]).alias("tool_name"),
            F.when(kind.isin(1, 2), args).alias("args"),
            F.when(kind == 3, F.concat(F.lit("/desk/sub/"), v.text_of("conv_id"), F.lit(".pdf"))).alias("saved_path"),
        ).alias("payload")))
    lines = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trace"), F.col("turn").alias("byte_offset"), line.alias("line"))
    found = logged_paths.logged_output_paths(
        trace_source.parse_events(lines), {"Desk": "/desk", "Sub": "/desk/sub"})
    return found.select("trace", "remote_path", "root_label", "first_seen")


# --- runs -----------------------------------------------------------------------------------------

def _requested(spark, sf) -> DataFrame:
    order = v.table(spark, sf, "orders")
    wanted = text.requested_formats(v.pick(v.mod("o_orderkey", 9), v.FORMAT_TEXTS))
    return order.select(F.col("o_orderkey").alias("case_id"), wanted.alias("required"))


@query
def present_formats(spark, sf):
    found = runs.present_formats(v.artifacts(spark, sf).where(F.col("status") == "pulled"))
    return found.select("case_id", joined("present_formats").alias("formats"))


@query
def missing_formats(spark, sf):
    present = runs.present_formats(v.artifacts(spark, sf).where(F.col("status") == "pulled"))
    both = _requested(spark, sf).join(present, "case_id", "left")
    return both.select(
        "case_id",
        joined(runs.missing_formats(F.col("required"), F.col("present_formats"))).alias("missing"),
        runs.all_present(F.col("required"), F.col("present_formats")).alias("all_present"))


@query
def missing_format_rows(spark, sf):
    required = exploded(_requested(spark, sf), ["case_id"], F.col("required"), "format")
    pulled = v.artifacts(spark, sf).where(F.col("status") == "pulled")
    present = pulled.select("case_id", text.path_format(F.col("path")).alias("format"))
    return runs.missing_format_rows(required, present).groupBy("format").agg(F.count(F.lit(1)).alias("n_cases"))


@query
def pull_counts(spark, sf):
    return runs.pull_counts(v.artifacts(spark, sf))


def _flagged(spark, sf) -> DataFrame:
    n = F.col("o_orderkey")
    outcome, kind = runs.run_outcome(
        n % 29 == 0, F.col("o_orderstatus") == "P", n % 7 == 0, n % 5 == 0, n % 3 == 0, n % 11 == 0)
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), "o_custkey", "o_orderdate", outcome.alias("outcome"), kind.alias("failure_kind"))


@query
def run_outcome(spark, sf):
    return _flagged(spark, sf).select("case_id", "outcome", "failure_kind")


@query
def failure_distribution(spark, sf):
    return runs.failure_distribution(_flagged(spark, sf))


def _record(found: DataFrame) -> DataFrame:
    return found.select(
        "case_id", "person", joined("required_formats").alias("required"), joined("present_formats").alias("present"),
        joined("missing_formats").alias("missing"), "outputs_pulled", "worklogs_pulled", "summaries_pulled",
        "dialog_verdict", "session_id", F.size("warnings").alias("n_warnings"), "outcome", "failure_kind")


@query
def run_result(spark, sf):
    return _record(run_results(spark, sf))


def run_results(spark, sf) -> DataFrame:
    """All traces to result records: a case per customer, its trace the events of user `case`, its
    reply the conversation of that number, its files the line items of that order. That order's status
    tells an interrupted run (P), and with its priority a failed preparation."""
    events = v.trace_events(spark, sf)
    ends = traces.trace_summary(events, timeout_seconds=86400).select(
        F.col("trace").alias("case_id"), "outcome", "session_id")
    replies = traces.last_reply(trace_source.parse_events(v.reply_lines(spark, sf))).select(
        F.col("trace").alias("case_id"), "reply")
    answers = ends.join(replies, "case_id", "left")
    return runs.run_results(_work(spark, sf), answers, v.artifacts(spark, sf), text.reply_verdict(F.col("reply"), WORD_RULES))


def _work(spark, sf) -> DataFrame:
    states = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "P").alias("interrupted"),
        ((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1")).alias("preparation_failed"))
    return v.tasks(spark, sf).select(F.col("task_no").alias("case_id"), "person", "task").join(states, "case_id", "left")


def _chain(spark, sf) -> DataFrame:
    """Results of the tasks that this attempt ran, three of four, from raw lines and listings."""
    return chain.results(
        _work(spark, sf).where(~v.mod("case_id", 4, 0)), v.case_lines(spark, sf), v.case_files(spark, sf),
        text.reply_verdict(F.col("reply"), WORD_RULES), timeout_seconds=86400)


@query
def chain_results(spark, sf):
    """The whole chain: lines and listings to result records."""
    return _record(_chain(spark, sf))


@query
def chain_totals(spark, sf):
    """The chain's results with the ledger of earlier attempts, as totals and readiness of batches."""
    earlier = v.ledger(spark, sf).withColumn("attempt", F.year("at"))
    entries = chain.status(v.simple_tasks(spark, sf), earlier, _chain(spark, sf), attempt=9999).withColumn(
        "run_id", v.mod("case_id", 200))
    return chain.totals(_batches(spark, sf), entries).withColumn("level", F.col("level").cast("bigint"))


@query
def attempts(spark, sf):
    return runs.attempts(v.ledger(spark, sf), order=("at", "run_key"))


@query
def current_attempts(spark, sf):
    daily = v.ledger(spark, sf).withColumn("attempt", F.date_trunc("year", F.col("at").cast("timestamp")))
    latest = runs.current_attempts(daily)
    return latest.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("run_key").alias("last_key"))


@query
def stop_on_error(spark, sf):
    o = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("person"), F.col("o_orderdate"), F.col("o_orderkey").alias("task_no"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 100 > 60)).alias("failed"))
    cut = runs.stop_on_error(
        o.withColumn("batch", F.col("person") % 7), order=("o_orderdate", "task_no"), group_order="person", batch="batch")
    return cut.select("batch", "person", "task_no", "executed")


@query
def task_status(spark, sf):
    led = v.ledger(spark, sf, moved=True).withColumn("attempt", F.date_trunc("year", F.col("at").cast("timestamp")))
    return runs.task_status(v.simple_tasks(spark, sf), led).select("case_id", "person", "execution_outcome")


def _entries(spark, sf) -> DataFrame:
    led = v.ledger(spark, sf, moved=True).withColumn("attempt", F.date_trunc("year", F.col("at").cast("timestamp")))
    n = F.col("case_id")
    at = lambda tail: F.concat(F.lit("/run/"), v.text_of("case_id"), F.lit(tail))
    return runs.task_status(v.simple_tasks(spark, sf), led).select(
        (n % 200).alias("run_id"), v.text_of("case_id").alias("task_id"), "person", "execution_outcome",
        at("/metadata.json").alias("metadata"), at("/trace.jsonl").alias("trace"), at("/outputs").alias("outputs"),
        at("/marker.json").alias("marker"), at("").alias("run_dir"),
        F.lit(True).alias("has_metadata"), (n % 97 != 0).alias("has_outputs"), F.lit(True).alias("has_run_dir"),
        (n % 89 != 0).alias("has_trace"), (F.col("execution_outcome") != "not-run").alias("has_marker"))


def _batches(spark, sf) -> DataFrame:
    """A batch for each of 200 remainders of customer keys, and one empty batch per nation."""
    used = v.table(spark, sf, "customer").select((F.col("c_custkey") % 200).alias("run_id")).distinct()
    empty = v.table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("run_id"))
    return used.unionByName(empty).withColumn("finished", F.col("run_id") % 9 != 0)


@query
def batch_ready(spark, sf):
    return runs.batch_ready(_batches(spark, sf), _entries(spark, sf))


@query
def batch_rollup(spark, sf):
    c = v.simple_tasks(spark, sf)
    r = v.ledger(spark, sf).join(c, "case_id").select(
        F.year("at").cast("bigint").alias("run_id"), "person", (F.col("marker") == "complete").alias("ok_run"))
    return runs.batch_rollup(r).withColumn("level", F.col("level").cast("bigint"))


@query
def meta_merge(spark, sf):
    updates = _field_updates(spark, sf)
    early = runs.meta_merge(updates.where(v.mod("event_id", 3, 0)))
    return runs.meta_merge(early.unionByName(updates.where(~v.mod("event_id", 3, 0))))


def _field_updates(spark, sf):
    """Field updates from events: a case per user, fields by event type, some set to null."""
    kind = F.col("event_type")
    field = (
        F.when(kind == "view", "remote_log").when(kind == "click", "session_id").when(kind == "signup", "dialog_verdict")
        .when(kind == "purchase", "dialog_round").otherwise("free_note"))
    value = F.when(~v.mod("event_id", 4, 0), F.concat(F.lit("v"), v.text_of("event_id")))
    return v.table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), field.alias("field"), value.alias("value"))


@query
def meta_kept(spark, sf):
    """The same updates as three writes to a kept state, two of them compacted before the third."""
    path = f"{checkpoint_folder(spark)}/meta-{uuid.uuid4().hex}"
    updates = _field_updates(spark, sf)
    for part in (2, 0, 1):
        meta_store.append_updates(updates.where(v.mod("event_id", 3, part)), path, {2: 1, 0: 2, 1: 3}[part])
        if part == 0:
            meta_store.compact(spark, path)
    return meta_store.read_meta(spark, path).select(F.col("case_id").cast("bigint").alias("case_id"), "field", "value", "seq")


@query
def manifest(spark, sf):
    return runs.manifest(v.artifacts(spark, sf)).select("case_id", "section", "sort_key.text", "path", "status", "size")


@query
def manifest_headers(spark, sf):
    files = v.artifacts(spark, sf)
    cases = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), v.text_of("o_custkey").alias("task_id"),
        F.concat(F.lit("s"), v.text_of("o_orderkey")).alias("session_id"), F.col("o_orderdate").alias("pulled_at"),
        F.when(v.mod("o_orderkey", 2, 0), "log").otherwise("listing").alias("selection_source"))
    return runs.manifest_headers(cases, files).select(
        "case_id", "task_id", "selection_source", "workspace.session_root", "n_outputs", "n_worklogs", "n_summaries")


@query
def folder_manifest(spark, sf):
    files = v.artifacts(spark, sf).select(
        "case_id", F.concat(F.lit("/docs/"), F.col("source"), F.col("path")).alias("remote_path"), "status")
    records = runs.folder_manifest(files, {"Desk": "/docs/report/w", "Papers": "/docs/summary/w/"})
    return records.select("case_id", "folder", "sort_key.text", "remote_path", "status", "local_path")


@query
def handoff(spark, sf):
    """Entries with their place in natural order, next to their batch's header."""
    headers, rows = runs.handoff(_batches(spark, sf), _entries(spark, sf))
    heads = headers.select("runId", F.col("runnerFinished").alias("runner_finished"), F.col("nTasks").alias("n_tasks"))
    return heads.join(rows, "runId", "left").select(
        F.col("runId").alias("run_id"), "ordinal", "runner_finished", "n_tasks", F.col("sort_key.kind").cast("bigint").alias("kind"),
        F.col("sort_key.digits").cast("bigint").alias("digits"), F.col("sort_key.text").alias("key_text"),
        F.concat_ws("|", "taskId", "executionOutcome", F.coalesce("trace", F.lit("-")), F.coalesce("marker", F.lit("-")),
                    "judgeInputs.runnerTaskDir").alias("entry"))
