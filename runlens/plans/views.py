"""How the provided tables stand in for traces, listings, polls, tasks and runs.

Each view covers its whole table. `oracles.py` states the same definitions in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mod(c: str | Column, n: int, *equal: int) -> Column:
    value = (F.col(c) if isinstance(c, str) else c) % n
    return value.isin(*equal) if equal else value


def text_of(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def pick(key: Column, values: list[str | None], dtype: str = "string") -> Column:
    """Value number `key` of a fixed list."""
    return F.element_at(F.array(*[F.lit(v).cast(dtype) for v in values]), (key + 1).cast("int"))


# --- traces ---------------------------------------------------------------------------------------

def trace_events(spark: SparkSession, sf: str) -> DataFrame:
    """events as parsed trace rows: a trace per user, ordered by event number."""
    kind = F.col("event_type")
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("trace"),
        F.col("event_id").alias("byte_offset"),
        F.when(kind == "view", "tool_call").otherwise("model_output").alias("event"),
        F.when(mod("event_id", 5, 0), "sub").otherwise("main").alias("agent_role"),
        F.when(mod("event_id", 3, 0), " ").otherwise(F.concat(F.lit(" s"), text_of(mod("event_id", 11)))).alias("session_id"),
        F.when(kind == "purchase", "stop").when(kind == "error", "error").otherwise("tool_use").alias("stop_reason"),
        "ts",
    )


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same as raw JSONL lines, some of them damaged."""
    e = trace_events(spark, sf)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    line = F.to_json(F.struct(
        "event", "agent_role", "session_id", stamp.alias("timestamp"),
        F.struct(F.struct("stop_reason").alias("assistant")).alias("payload"),
    ))
    damaged = (
        F.when(mod("byte_offset", 13, 0), F.substring(line, 1, 40))
        .when(mod("byte_offset", 17, 0), F.lit("[1,2]"))
        .when(mod("byte_offset", 19, 0), F.concat(line, F.lit(" junk")))
        .otherwise(line)
    )
    return e.select("trace", "byte_offset", damaged.alias("line"))


def reply_lines(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as raw JSONL lines: a trace per conversation, ordered by turn."""
    item = "struct<type:string,text:string>"
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")).cast(item)
    words = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text")).cast(item)
    content = F.when(mod("turn", 5, 4), F.array(image)).otherwise(
        F.array(words(F.col("text")), image, words(F.lit("!")))
    )
    role = F.col("role")
    line = F.to_json(F.struct(
        F.lit("model_output").alias("event"),
        F.when(role == "system", "sub").otherwise("main").alias("agent_role"),
        F.concat(F.lit("c"), text_of("conv_id")).alias("session_id"),
        F.struct(F.struct(
            F.when(role == "user", "tool_use").otherwise("stop").alias("stop_reason"), content.alias("content")
        ).alias("assistant")).alias("payload"),
    ))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trace"), F.col("turn").alias("byte_offset"), line.alias("line")
    )


# --- listings -------------------------------------------------------------------------------------

def epoch(c: str | Column = "ts") -> Column:
    return F.unix_seconds((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def listing_lines(spark: SparkSession, sf: str, separator: str) -> DataFrame:
    """events as `mtime<sep>size<sep>path` lines, some of them damaged."""
    size = F.when(mod("event_id", 23, 0), "n/a").otherwise(text_of("event_id"))
    path = F.concat(F.lit("/logs/u"), text_of("user_id"), F.lit(f"/a{separator}b"), text_of("event_id"),
                    F.when(mod("event_id", 4, 0), ".txt").otherwise(".jsonl"))
    full = F.concat_ws(separator, text_of(epoch()), size, path)
    line = F.when(mod("event_id", 29, 0), text_of("event_id")).otherwise(F.concat(F.lit("  "), full, F.lit("\t")))
    return table(spark, sf, "events").select("event_id", "user_id", "ts", line.alias("line"))


def log_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A listing block per user, closed on 29 January; every 7th user's end marker is damaged."""
    lines = listing_lines(spark, sf, " ").select(F.col("user_id").alias("block"), epoch().alias("line_no"), "line")
    ends = table(spark, sf, "events").select(F.col("user_id").alias("block")).distinct()
    marker = F.when(mod("block", 7, 0), "__EN").otherwise("__END__")
    return lines.unionByName(ends.select("block", F.lit(JAN_29).alias("line_no"), marker.alias("line")))


JAN_11, JAN_21, JAN_29 = 1704931200, 1705795200, 1706486400


def section_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A sectioned listing per user; every 6th user's summary marker is damaged."""
    lines = listing_lines(spark, sf, "|").select(F.col("user_id").alias("payload_id"), epoch().alias("line_no"), "line")
    users = table(spark, sf, "events").select(F.col("user_id").alias("payload_id")).distinct()
    marks = users.select("payload_id", F.explode(F.array(
        F.struct(F.lit(JAN_11).alias("line_no"), F.lit("__WORKLOG__").alias("line")),
        F.struct(F.lit(JAN_21).alias("line_no"), F.lit("__SUMMARY__").alias("line")),
        F.struct(F.lit(JAN_29).alias("line_no"), F.lit("__END__").alias("line")),
    )).alias("m")).select("payload_id", "m.*")
    damaged = mod("payload_id", 6, 0) & (F.col("line") == "__SUMMARY__")
    return lines.unionByName(marks.withColumn("line", F.when(damaged, "__SUM").otherwise(F.col("line"))))


def snapshot(spark: SparkSession, sf: str, until: str | None = None) -> DataFrame:
    """A log file per user: as many bytes as events, changed at the last one."""
    e = table(spark, sf, "events")
    if until:
        e = e.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    path = F.concat(F.lit("/logs/u"), text_of("user_id"), F.lit(".jsonl"))
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("size"), F.max(epoch()).alias("mtime"), F.min(epoch()).alias("created")
    ).select("user_id", path.alias("path"), F.concat(F.lit("u"), text_of("user_id"), F.lit(".jsonl")).alias("name"),
             "size", "mtime", "created")


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot of mid January: some files later vanished, some shrank, some were only touched."""
    s = snapshot(spark, sf, "2024-01-15")
    return s.select(
        F.when(mod("user_id", 8, 0), F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") + F.when(mod("user_id", 3, 0), 1_000_000).otherwise(0)).alias("size"),
        (F.col("mtime") + F.when(mod("user_id", 5, 0), 100_000_000).otherwise(0)).alias("mtime"),
    )


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """A poll per user and day; the signature follows the number of events so far.

    Events are reduced to one row per user and day before the window, which then sees at most one
    row per day.
    """
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint")
    daily = table(spark, sf, "events").groupBy("user_id", day.alias("poll_no")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(
        Window.partitionBy("user_id").orderBy("poll_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return daily.select(
        F.col("user_id").alias("session_id"), "poll_no",
        F.floor(so_far / 8).cast("bigint").alias("signature"),
        ((so_far >= 5) & ((F.col("poll_no") + F.col("user_id")) % 9 != 0)).alias("present"),
    )


# --- paths ----------------------------------------------------------------------------------------

def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """pages.url as a path `/host/lang/...`, without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


def page_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Roots: every host, and every host with its language."""
    p = page_paths(spark, sf)
    host = F.concat(F.lit("/"), F.split("path", "/")[1])
    both = F.array(host, F.concat(host, F.lit("/"), F.split("path", "/")[2]))
    return p.select(F.explode(both).alias("root_path")).distinct().withColumn(
        "root_label", F.concat(F.lit("L:"), F.col("root_path"))
    )


# --- tasks ----------------------------------------------------------------------------------------

FORMAT_TEXTS = [
    "写周报", "生成docx文件", "输出 docx 和 pdf 文件", "保存为 report.md，", "导出 Word 文档", "a.doc",
    "x.HTM and notes.markdown", "data.jsonl", "Excel 表格, PowerPoint文件 及 csv",
]
WEEK_TEXTS = ["第一周的周报", "第二周的周报", "月报", "firstweek report"]


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """customer as task metadata, with every kind of registry violation."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    plain = text_of(key)
    task_id = (
        F.when(mod(key, 31, 0), F.concat(F.lit("A"), plain))
        .when(mod(key, 37, 0), F.concat(plain, F.lit(".")))
        .when(mod(key, 41, 0), F.concat(F.lit("x/"), plain))
        .when(mod(key, 43, 0), F.lit(" "))
        .when(mod(key, 47, 0), F.concat(F.lit("T"), text_of(key % 10)))
        .when(mod(key, 53, 0), F.concat(F.lit("t"), text_of(key % 10)))
        .otherwise(plain)
    )
    text = F.concat(pick(key % 4, WEEK_TEXTS), F.lit(" "), pick(key % 9, FORMAT_TEXTS), F.lit("  \n"))
    return c.select(
        F.concat(F.lit("/task/"), F.col("n_name"), F.lit("/"), plain).alias("path"),
        F.when(mod(key, 59, 0), "NOBODY").otherwise(F.col("n_name")).alias("dir_person"),
        F.when(mod(key, 61, 0), "other").otherwise(task_id).alias("dir_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "other-report").otherwise("weekly-report").alias("adapter"),
        F.col("n_name").alias("person"),
        task_id.alias("absolute_id"),
        F.when(mod(key, 67, 0), F.lit("　\n")).otherwise(text).alias("task"),
        F.when(mod(key, 20, 3), F.concat(F.lit(" N"), text_of("c_nationkey"), F.lit("W1 "))).alias("mock_target"),
        F.when(mod(key, 7, 2), "2").when(mod(key, 7, 4), "9").when(mod(key, 7, 5), "第一周").alias("mock_week"),
        key.alias("task_no"),
        "c_nationkey",
    )


def simple_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """customer as (case_id, task_id, person) with plain ids."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("case_id"), F.col("n_name").alias("person"))


def target_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Two target codes per nation: `n<key>w1`, `n<key>w2`."""
    weeks = F.explode(F.array(
        F.struct(F.lit(1).alias("week"), F.lit("第一周").alias("week_label")),
        F.struct(F.lit(2).alias("week"), F.lit("第二周").alias("week_label")),
    )).alias("w")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("person"), weeks)
    code = F.concat(F.lit("n"), text_of("n_nationkey"), F.lit("w"), text_of("w.week"))
    return n.select(code.alias("target"), "person", "w.week", "w.week_label")


# --- runs -----------------------------------------------------------------------------------------

FAILURES = ["timeout", "agent-error", "missing-deliverables", "execution-error", "data-preparation"]


def ledger(spark: SparkSession, sf: str, moved: bool = False) -> DataFrame:
    """orders as run markers: a case per customer, attempts in order of date and key.

    With `moved`, the runs of every 13th customer belong to a case outside the registry.
    """
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    kind = pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, FAILURES)
    away = F.when(F.lit(moved) & mod("o_custkey", 13, 0), 1_000_000_000).otherwise(0)
    return o.select(
        (F.col("o_custkey") + away).alias("case_id"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("run_key"),
        F.when(status == "F", "failed").when(status == "P", "interrupted").otherwise("complete").alias("marker"),
        F.when(status == "F", kind).alias("failure_kind"),
    )


EXTENSIONS = {"A": ".docx", "N": ".HTM", "R": ".pdf"}


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as pulled files: a case per order, source by supplier, format by return flag."""
    flag = F.col("l_returnflag")
    ext = F.when(flag == "A", EXTENSIONS["A"]).when(flag == "N", EXTENSIONS["N"]).otherwise(EXTENSIONS["R"])
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.when(mod("l_suppkey", 4, 0), "worklog").when(mod("l_suppkey", 4, 1), "summary").otherwise("report").alias("source"),
        F.concat(F.lit("/w/p"), text_of("l_partkey"), F.lit("-"), text_of("l_linenumber"), ext).alias("path"),
        F.when(F.col("l_linestatus") == "O", "pulled").otherwise("failed").alias("status"),
        F.col("l_quantity").cast("bigint").alias("size"),
    )


# --- the whole chain ------------------------------------------------------------------------------

def case_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines of a case: the events of the user of that number, then the turns of that conversation."""
    later = F.col("byte_offset") + 1_000_000_000_000
    return event_lines(spark, sf).unionByName(reply_lines(spark, sf).withColumn("byte_offset", later)).select(
        F.col("trace").alias("case_id"), "byte_offset", "line")


def case_files(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as the files on the device of a case: reports below one of 11 sessions, shared logs and summaries."""
    below = F.when(F.col("source") == "report", F.concat(F.lit("s"), text_of(mod("size", 11)))).when(
        F.col("source") == "worklog", "memory/weekly-work-report/worklog").otherwise("memory/weekly-work-report/summary")
    path = F.concat(F.lit("/workspace/"), below, F.substring("path", 3, 1000))
    return artifacts(spark, sf).select("case_id", path.alias("path"), "size", "status")
