"""SQL that states the expected result of every query on the same tables, for DuckDB.

The statements are written from the definitions, not from the Spark plans: where a query parses
JSON lines or listing text, the SQL reads the columns those were made of.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_VIEWS = {
    "tr": """SELECT user_id AS trace, event_id AS n, ts, event_type AS kind,
        CASE WHEN event_id % 5 = 0 THEN 'sub' ELSE 'main' END AS role,
        CASE event_type WHEN 'purchase' THEN 'stop' WHEN 'error' THEN 'error' ELSE 'tool_use' END AS reason,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || (event_id % 11) END AS session,
        (event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0) AS bad
        FROM events""",
    "lst": """SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS mtime, event_id AS size,
        CASE WHEN event_id % 4 = 0 THEN '.txt' ELSE '.jsonl' END AS ext
        FROM events WHERE event_id % 29 <> 0 AND event_id % 23 <> 0""",
    "snap": """SELECT user_id, '/logs/u' || user_id || '.jsonl' AS path, 'u' || user_id || '.jsonl' AS name,
        count(*) AS size, max(CAST(floor(epoch(ts)) AS BIGINT)) AS mtime, min(CAST(floor(epoch(ts)) AS BIGINT)) AS created
        FROM events GROUP BY user_id""",
    "base": """SELECT user_id, '/logs/u' || user_id || '.jsonl' || CASE WHEN user_id % 8 = 0 THEN '.old' ELSE '' END AS path,
        count(*) + CASE WHEN user_id % 3 = 0 THEN 1000000 ELSE 0 END AS size,
        max(CAST(floor(epoch(ts)) AS BIGINT)) + CASE WHEN user_id % 5 = 0 THEN 100000000 ELSE 0 END AS mtime
        FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id""",
    "chg": """SELECT s.*, CASE WHEN b.path IS NULL THEN 'new' WHEN s.size > b.size THEN 'grew'
        WHEN s.mtime > b.mtime THEN 'touched' ELSE 'same' END AS change_kind
        FROM snap s LEFT JOIN base b USING (path)""",
    "pol": """SELECT user_id, d, so_far // 8 AS sig, (so_far >= 5 AND (d + user_id) % 9 <> 0) AS present FROM (
        SELECT user_id, d, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY d) AS BIGINT) AS so_far FROM (
        SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, count(*) AS n FROM events GROUP BY 1, 2))""",
    "isl": """SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY d) AS island FROM (
        SELECT *, CASE WHEN present AND lag(present) OVER w AND lag(sig) OVER w = sig THEN 0 ELSE 1 END AS brk
        FROM pol WINDOW w AS (PARTITION BY user_id ORDER BY d))""",
    "run": """SELECT user_id, d, CASE WHEN present THEN row_number() OVER (PARTITION BY user_id, island ORDER BY d) ELSE 0 END AS run
        FROM isl""",
    "pg": """SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS path FROM pages""",
    "pgh": """SELECT page_id, path, '/' || split_part(path, '/', 2) AS host, split_part(path, '/', 3) AS lang FROM pg""",
    "roots": """SELECT DISTINCT root FROM (SELECT host AS root FROM pgh UNION ALL SELECT host || '/' || lang FROM pgh)""",
    "tsk": """SELECT c_custkey AS k, n_name AS person, c_nationkey, c_mktsegment,
        CASE WHEN c_custkey % 31 = 0 THEN 'A' || c_custkey WHEN c_custkey % 37 = 0 THEN c_custkey || '.'
             WHEN c_custkey % 41 = 0 THEN 'x/' || c_custkey WHEN c_custkey % 43 = 0 THEN ' '
             WHEN c_custkey % 47 = 0 THEN 'T' || (c_custkey % 10) WHEN c_custkey % 53 = 0 THEN 't' || (c_custkey % 10)
             ELSE c_custkey::VARCHAR END AS id,
        CASE WHEN c_custkey % 20 = 3 THEN 'n' || c_nationkey || 'w1' ELSE '' END AS explicit,
        CASE c_custkey % 7 WHEN 2 THEN '2' WHEN 4 THEN '9' WHEN 5 THEN '第一周' ELSE '' END AS week,
        CASE WHEN c_custkey % 67 = 0 THEN 0 WHEN c_custkey % 4 = 0 THEN 1 WHEN c_custkey % 4 = 1 THEN 2 ELSE 0 END AS text_week
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fmt": """SELECT * FROM (VALUES (0, ['docx', 'html']), (1, ['docx', 'html']), (2, ['docx', 'pdf']), (3, ['md']),
        (4, ['docx']), (5, ['doc']), (6, ['html', 'md']), (7, ['jsonl']), (8, ['csv', 'pptx', 'xlsx'])) AS t(k, formats)""",
    "art": """SELECT l_orderkey AS case_id, CASE l_suppkey % 4 WHEN 0 THEN 'worklog' WHEN 1 THEN 'summary' ELSE 'report' END AS source,
        CASE l_returnflag WHEN 'A' THEN '.docx' WHEN 'N' THEN '.HTM' ELSE '.pdf' END AS ext,
        CASE l_returnflag WHEN 'A' THEN 'docx' WHEN 'N' THEN 'html' ELSE 'pdf' END AS format,
        '/w/p' || l_partkey || '-' || l_linenumber AS stem, l_linestatus = 'O' AS pulled, CAST(l_quantity AS BIGINT) AS size FROM lineitem""",
    "led": """SELECT o_custkey AS case_id, o_orderdate AS started, o_orderkey AS run_key, year(o_orderdate) AS yr,
        CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'interrupted' ELSE 'complete' END AS marker,
        CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority[1] WHEN '1' THEN 'timeout' WHEN '2' THEN 'agent-error'
          WHEN '3' THEN 'missing-deliverables' WHEN '4' THEN 'execution-error' ELSE 'data-preparation' END END AS kind
        FROM orders""",
    "old": "SELECT * REPLACE (case_id + CASE WHEN case_id % 13 = 0 THEN 1000000000 ELSE 0 END AS case_id) FROM led",
    "sta": """SELECT c_custkey AS case_id, n_name AS person, CASE
        WHEN bool_or(marker = 'interrupted') THEN 'interrupted' WHEN bool_or(marker = 'failed') THEN 'failed'
        WHEN bool_or(marker = 'complete') THEN 'complete' ELSE 'not-run' END AS outcome
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT * FROM old o WHERE yr = (SELECT max(yr) FROM old p WHERE p.case_id = o.case_id)) o ON o.case_id = c_custkey
        GROUP BY 1, 2""",
    "ent": """SELECT case_id, case_id % 200 AS run_id, outcome, case_id % 97 <> 0 AS has_outputs, case_id % 89 <> 0 AS has_trace,
        outcome <> 'not-run' AND (outcome <> 'complete' OR (case_id % 97 <> 0 AND case_id % 89 <> 0)) AS ready FROM sta""",
    "bat": """SELECT DISTINCT c_custkey % 200 AS run_id FROM customer UNION ALL SELECT n_nationkey + 1000 FROM nation""",
    "flg": """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 29 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'interrupted'
        WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 THEN 'failed' ELSE 'complete' END AS outcome,
        CASE WHEN o_orderkey % 29 = 0 THEN 'data-preparation' WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 7 = 0 THEN 'timeout'
        WHEN o_orderkey % 5 = 0 THEN 'agent-error' WHEN o_orderkey % 3 = 0 THEN 'missing-deliverables'
        WHEN o_orderkey % 11 = 0 THEN 'execution-error' END AS failure_kind FROM orders""",
}

# Letters, digits and underscore make words in every script; RE2 has no Unicode \b.
_B, _E = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def _word(pattern: str) -> str:
    return pattern.replace("<", _B).replace(">", _E)


def _found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?is){_word(pattern)}')"


def oracle(name: str, body: str, *views: str) -> None:
    needed: list[str] = []
    parents = {"chg": ["snap", "base"], "isl": ["pol"], "run": ["pol", "isl"], "pgh": ["pg"], "roots": ["pg", "pgh"],
               "old": ["led"], "sta": ["led", "old"], "ent": ["led", "old", "sta"]}
    for view in views:
        for each in [*parents.get(view, []), view]:
            if each not in needed:
                needed.append(each)
    with_clause = ", ".join(f"{view} AS ({_VIEWS[view]})" for view in needed)
    ORACLES[name] = (f"WITH {with_clause} " if needed else "") + body


# --- traces ---------------------------------------------------------------------------------------

oracle("trace_scan", """SELECT trace, count(*) AS n_lines, count(*) FILTER (bad) AS n_malformed,
    count(*) FILTER (NOT bad AND role = 'main') AS n_main, count(*) FILTER (NOT bad AND reason = 'stop') AS n_stop,
    count(*) FILTER (NOT bad AND kind = 'view') AS n_tool_calls,
    min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z') FILTER (NOT bad) AS first_timestamp FROM tr GROUP BY trace""", "tr")
oracle("trace_terminal", """SELECT trace, arg_max(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS stop_reason
    FROM tr GROUP BY trace""", "tr")
oracle("trace_has_stop", """SELECT trace, coalesce(arg_max(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') = 'stop', false) AS has_stop
    FROM tr GROUP BY trace""", "tr")
oracle("trace_terminal_raw", """SELECT trace, arg_max(reason, n) FILTER (NOT bad AND role = 'main' AND reason <> 'tool_use') AS stop_reason
    FROM tr GROUP BY trace""", "tr")
oracle("trace_recent_terminal", """SELECT trace, arg_max(reason, n)
        FILTER (kind <> 'view' AND rn <= 3 AND role = 'main' AND reason <> 'tool_use') AS stop_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY trace, kind = 'view' ORDER BY n DESC) AS rn FROM tr)
    GROUP BY trace""", "tr")
oracle("trace_last_reply", """SELECT conv_id AS trace, arg_max(text || '!', turn) FILTER (role = 'assistant' AND turn % 5 <> 4) AS reply
    FROM conversations GROUP BY conv_id""")
oracle("trace_main_session", """SELECT trace, coalesce(arg_min(session, n) FILTER (role = 'main' AND session IS NOT NULL),
    arg_min(session, n) FILTER (session IS NOT NULL)) AS session_id FROM tr GROUP BY trace""", "tr")
oracle("trace_stop_count_last_n", """SELECT trace, count(*) FILTER (rn <= 20 AND kind <> 'view' AND role = 'main' AND reason = 'stop') AS n_stop
    FROM (SELECT *, row_number() OVER (PARTITION BY trace, kind <> 'view' ORDER BY n DESC) AS rn FROM tr) GROUP BY trace""", "tr")
oracle("trace_created", """SELECT trace, CASE WHEN arg_min(bad, n) THEN max(CAST(floor(epoch(ts)) AS BIGINT)) * 1000000
    ELSE arg_min(epoch_us(ts), n) END AS created_us FROM tr GROUP BY trace""", "tr")
oracle("trace_since_baseline", """, b AS (SELECT trace + CASE WHEN trace % 10 = 0 THEN 1000000000 ELSE 0 END AS trace, max(n) + 1 AS base
      FROM tr WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT trace, count(*) AS n_events, arg_max(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS stop_reason
    FROM tr LEFT JOIN b USING (trace) WHERE n >= coalesce(base, 0) GROUP BY trace""", "tr")
oracle("trace_outcome_timeout", """SELECT trace, CASE WHEN ended_at < started + INTERVAL 1 DAY THEN reason ELSE 'timeout' END AS outcome,
    epoch_us(started) AS started_us,
    epoch_us(CASE WHEN ended_at < started + INTERVAL 1 DAY THEN ended_at ELSE started + INTERVAL 1 DAY END) AS ended_us FROM (
    SELECT trace, min(ts) AS started, arg_min(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS reason,
    arg_min(ts, n) FILTER (role = 'main' AND reason <> 'tool_use') AS ended_at FROM tr GROUP BY trace)""", "tr")

oracle("trace_summary", """SELECT trace, CASE WHEN ended_at < started + INTERVAL 1 DAY THEN first_reason ELSE 'timeout' END AS outcome,
    latest_reason, session_id FROM (
    SELECT trace, min(ts) AS started, arg_min(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS first_reason,
    arg_max(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS latest_reason,
    arg_min(ts, n) FILTER (role = 'main' AND reason <> 'tool_use') AS ended_at,
    coalesce(arg_min(session, n) FILTER (role = 'main' AND session IS NOT NULL), arg_min(session, n) FILTER (session IS NOT NULL)) AS session_id
    FROM tr GROUP BY trace)""", "tr")

# --- listings -------------------------------------------------------------------------------------

oracle("listing_parse", "SELECT '/logs/u' || user_id || '/a|b' || event_id || ext AS path, size, mtime FROM lst", "lst")
oracle("log_listing_parse", """SELECT user_id AS block, '/logs/u' || user_id || '/a b' || event_id || ext AS path,
    'a b' || event_id || ext AS name, size, mtime FROM lst
    WHERE user_id % 7 <> 0 AND ext = '.jsonl' AND mtime < 1706486400""", "lst")
oracle("listing_sections", """SELECT user_id AS payload_id, CASE WHEN mtime < 1704931200 THEN 'report'
    WHEN mtime > 1704931200 AND mtime < 1705795200 THEN 'worklog' ELSE 'summary' END AS section, count(*) AS n_files,
    CAST(sum(size) AS BIGINT) AS bytes FROM lst
    WHERE user_id % 6 <> 0 AND mtime < 1706486400 AND mtime NOT IN (1704931200, 1705795200) GROUP BY 1, 2
    UNION ALL SELECT DISTINCT user_id, 'missing-section-marker', 0, 0 FROM events WHERE user_id % 6 = 0""", "lst")
oracle("listing_users", """SELECT DISTINCT 'u' || user_id AS user_id FROM events
    WHERE event_id % 50 <> 0 AND event_id % 51 <> 0 AND event_id % 52 <> 0""")
oracle("prompt_quality", """SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'blank' WHEN 2 THEN 'nul-character' WHEN 3 THEN 'invalid-utf8' END AS problem,
    CASE WHEN doc_id % 7 NOT IN (1, 2, 3) THEN length(text) END AS n_chars FROM documents""")
oracle("snapshot_diff", "SELECT path, size, mtime, change_kind FROM chg", "chg")
oracle("snapshot_active", """SELECT user_id % 10 AS device, arg_max(path, (mtime, size, path)) AS path,
    arg_max(size, (mtime, size, path)) AS size, max(mtime) AS mtime FROM chg WHERE change_kind <> 'same' GROUP BY 1""", "chg")
oracle("snapshot_new_main", """SELECT user_id % 10 AS device, arg_min(path, (-length(name), created, path)) AS path,
    arg_min(created, (-length(name), created, path)) AS created
    FROM snap WHERE path NOT IN (SELECT path FROM base WHERE size < 1000000) GROUP BY 1""", "snap", "base")
oracle("snapshot_watched", """SELECT user_id % 40 AS device,
    coalesce(arg_min(path, (-length(name), created, path)) FILTER (change_kind = 'new'),
             arg_max(path, (mtime, size, path)) FILTER (change_kind <> 'same')) AS path,
    CASE WHEN bool_or(change_kind = 'new') THEN 'new' ELSE 'changed' END AS origin
    FROM chg WHERE change_kind <> 'same' GROUP BY 1""", "chg")
oracle("listing_signature", """WITH g AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day,
    count(DISTINCT (event_type, event_id % 2)) AS n_files, list_sort(list(DISTINCT event_type || (event_id % 2))) AS files FROM events GROUP BY 1, 2)
    SELECT user_id, day, n_files, min(day) OVER (PARTITION BY user_id, files) AS same_as FROM g""")
oracle("poll_states", """, p AS (SELECT o_custkey AS session_id, year(o_orderdate) * 12 + month(o_orderdate) AS poll_no, o_orderkey FROM orders),
    f AS (SELECT session_id, poll_no, source, format FROM art JOIN p ON o_orderkey = case_id),
    g AS (SELECT session_id, poll_no, count(*) AS n_files,
      bool_or(source = 'worklog') AS w, bool_or(source = 'report') AS r, bool_or(source = 'report' AND format = 'docx') AND bool_or(source = 'report' AND format = 'html') AS pair
      FROM f GROUP BY 1, 2)
    SELECT session_id, poll_no, coalesce(n_files, 0) AS n_files,
      coalesce(w AND CASE WHEN session_id % 3 = 0 THEN pair ELSE r END, false) AS present
      FROM (SELECT DISTINCT session_id, poll_no FROM p) LEFT JOIN g USING (session_id, poll_no)""", "art")
oracle("stability_runs", """SELECT user_id AS session_id, d AS poll_no, sig AS signature, present, run FROM run JOIN pol USING (user_id, d) WHERE user_id >= 10
    UNION ALL SELECT CASE WHEN d % 2 = 0 THEN user_id END, CASE WHEN d % 2 <> 0 THEN d END, sig, present, 0 FROM pol""", "run")
oracle("stability_first", """SELECT user_id AS session_id, CASE WHEN user_id >= 10 THEN coalesce(min(d) FILTER (run >= 2), max(d)) END AS poll_no,
    user_id >= 10 AND count(*) FILTER (run >= 2) > 0 AS stable FROM run GROUP BY user_id HAVING user_id >= 10 OR count(*) FILTER (d % 2 = 0) > 0""", "run")
oracle("session_artifacts", """, p AS (SELECT host[2:] AS device, 's' || (page_id % 60) AS session_id, page_id FROM pgh),
    w AS (SELECT DISTINCT device, CASE WHEN page_id % 5 = 0 THEN 'none' || page_id ELSE session_id END AS session_id FROM p),
    r AS (SELECT device, session_id, count(*) AS n, string_agg(DISTINCT f, ',' ORDER BY f) AS formats FROM (
        SELECT *, CASE page_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'html' ELSE 'md' END AS f FROM p) GROUP BY 1, 2),
    s AS (SELECT device, count(*) AS n FROM p GROUP BY 1)
    SELECT device, session_id, coalesce(r.n, 0) AS n_reports, coalesce(formats, '') AS report_formats, s.n AS n_worklogs, s.n AS n_summaries
    FROM w LEFT JOIN r USING (device, session_id) JOIN s USING (device)""", "pgh")
oracle("session_artifact_rows", """SELECT source, count(*) AS n_files, count(DISTINCT case_id) AS n_cases FROM art GROUP BY source""", "art")

# --- paths ----------------------------------------------------------------------------------------

oracle("longest_root", """SELECT page_id, path, arg_max(root, length(root)) AS root_path, 'L:' || arg_max(root, length(root)) AS root_label
    FROM pg JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY page_id, path""", "roots")
_RESOLVE = """, l AS (SELECT CASE WHEN page_id % 3 = 0 THEN '/moved' || path WHEN page_id % 4 = 1 THEN host || '/worklog/' || page_id || '.md'
      ELSE rtrim(path, '/') || '/f' END AS path, page_id AS size FROM pgh),
    c AS (SELECT DISTINCT CASE WHEN page_id % 5 = 0 THEN host || '/worklog/' WHEN page_id % 7 = 0 THEN host || '/文件输出/x'
      ELSE rtrim(path, '/') || '/f' END AS claim FROM pgh),
    w AS (SELECT rtrim(claim, '/') AS remote_path, contains(claim, '文件输出') AS excluded, bool_or(length(claim) % 11 = 0) AS failed FROM c GROUP BY ALL),
    b AS (SELECT remote_path, arg_max('L:' || root, length(root)) AS root_label
      FROM w JOIN roots ON remote_path = root OR starts_with(remote_path, root || '/') GROUP BY remote_path),
    m AS (SELECT remote_path, path, size FROM w JOIN l ON path = remote_path
      OR (contains(remote_path, 'worklog') AND starts_with(path, remote_path || '/')) WHERE NOT excluded AND NOT failed) """
oracle("resolve_paths", _RESOLVE + """SELECT remote_path, CASE WHEN excluded THEN 'ignored_internal_workspace' WHEN failed THEN 'resolve_failed'
    WHEN count(path) > 0 THEN 'found' ELSE 'not_found' END AS status, count(path) AS n_files,
    CASE WHEN failed AND NOT excluded THEN 'timed out' END AS error
    FROM w LEFT JOIN m USING (remote_path) GROUP BY remote_path, excluded, failed""", "roots")
oracle("resolve_path_matches", _RESOLVE + "SELECT remote_path, path, size, root_label FROM m LEFT JOIN b USING (remote_path)", "roots")
oracle("safe_relative", """, d AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN path || '/.././/x.md' ELSE path END AS p,
      CASE WHEN page_id % 6 = 0 THEN '/none' ELSE host END AS root,
      CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'worklog' ELSE 'summary' END AS label FROM pgh),
    e AS (SELECT *, CASE WHEN starts_with(p, root || '/') THEN substr(p, length(root) + 2) ELSE split_part(rtrim(p, '/'), '/', -1) END AS below FROM d)
    SELECT page_id, array_to_string(list_concat(CASE WHEN label IS NULL THEN [] ELSE [label] END,
      list_filter(string_split(below, '/'), lambda x: x NOT IN ('', '.', '..'))), '/') AS relative FROM e""", "pgh")
# ends of a logged path after clean-up, by page_id % 7; '' ends have no extension
_ENDS = "CASE page_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' WHEN 3 THEN '' WHEN 4 THEN '.html' WHEN 5 THEN '.PDF' ELSE '.csv' END"
oracle("workspace_path", f"""SELECT page_id, CASE
    WHEN page_id % 13 = 0 OR page_id % 10 IN (2, 3, 4, 5, 7, 9) THEN NULL
    WHEN page_id % 10 <> 6 AND page_id % 7 IN (2, 3) THEN NULL
    ELSE '/workspace/s' || (page_id % 9) || '/' || CASE page_id % 10 WHEN 6 THEN 'worklog/' WHEN 8 THEN 'a/b/' ELSE 'out/' END
      || page_id || {_ENDS} END AS remote_path FROM pages""")
oracle("path_flags", f"""SELECT page_id, clean, page_id % 4 IN (2, 3) OR page_id % 10 = 6 AS is_worklog,
    CASE page_id % 4 WHEN 0 THEN page_id % 7 NOT IN (2, 3) WHEN 1 THEN true ELSE false END AS has_extension,
    page_id % 4 = 1 AS is_excluded FROM (SELECT page_id, CASE page_id % 10 WHEN 0 THEN './out/' WHEN 1 THEN 'out\\' WHEN 2 THEN '../' WHEN 3 THEN '/abs/'
      WHEN 4 THEN 'C:\\' WHEN 5 THEN 'http://h/' WHEN 6 THEN 'worklog/' WHEN 7 THEN '' WHEN 8 THEN 'a//./b/' ELSE 'x/../' END
      || page_id || {_ENDS} AS clean FROM pages)""")
oracle("url_path_flags", r"""SELECT page_id, clean, regexp_matches(lower(clean), 'worklog|work_log|work-log|工作日志|工作记录') AS is_worklog,
    regexp_matches(regexp_extract(clean, '[^/]*$'), '(?i)[^.]\.(md|markdown|html?|docx?|pdf|xlsx?|csv|jsonl?|txt|log)$') AS has_extension,
    contains(clean, '工作快捷区') OR contains(clean, '文件输出') AS is_excluded
    FROM (SELECT page_id, regexp_replace(url || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '。' WHEN 2 THEN '/Work-Log/x.MD).'
      WHEN 3 THEN '/工作快捷区/a.jsonl' ELSE '/b.HTML?!' END, '[.,;:!?，。；：！？)\]}》]+$', '') AS clean FROM pages)""")
oracle("root_paths", """SELECT page_id, unnest(CASE page_id % 3
    WHEN 0 THEN ['/out/desk/sub/' || page_id, '/out/desk/sub/' || page_id]
    WHEN 1 THEN ['/out/desk/sub/n' || page_id || '.exe; res/' || page_id || '.csv', '/out/desk/' || page_id || '.md',
                 '/out/desk/sub/n' || page_id || '.exe; res/' || page_id || '.csv']
    ELSE ['/out/desk/sub/' || page_id || '.html', '/out/desk/sub/' || page_id || '.html'] END) AS found FROM pages""")
oracle("relative_paths", """SELECT page_id, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS found FROM (
    SELECT page_id, CASE page_id % 3
    WHEN 1 THEN ['my dir/' || page_id || '.docx', '/out/desk/' || page_id || '.md', 'dir/' || page_id || '.docx', 'res/' || page_id || '.csv']
    ELSE ['/out/desk/sub/' || page_id || '.html', '/out/desk/sub/' || page_id || '.html', 'worklog/' || page_id, 'worklog/' || page_id] END AS f
    FROM pages WHERE page_id % 3 <> 0)""")

# --- tasks ----------------------------------------------------------------------------------------

oracle("target_list", r"""SELECT conv_id, code, (m).t AS pos, (m).i AS item_pos FROM (
    SELECT conv_id, code, min({'t': turn, 'i': i - 1}) AS m FROM (
      SELECT conv_id, turn, lower(u.code) AS code, u.i AS i FROM conversations,
        unnest(regexp_split_to_array(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[,，\s\p{Z}]+')) WITH ORDINALITY AS u(code, i))
    WHERE code <> '' GROUP BY conv_id, code)""")
oracle("id_validation", """SELECT k AS task_no, CASE WHEN trim(id) = '' THEN 'blank' WHEN id LIKE '%.' THEN 'trailing-dot' WHEN contains(id, '/') THEN 'unsafe-character' END AS id_problem,
    CASE WHEN k % 5 = 2 THEN 'parent-reference' WHEN k % 5 IN (1, 4) THEN 'path-separator' WHEN trim(id) = '' THEN 'blank'
    WHEN contains(id, '/') THEN 'path-separator' END AS session_problem FROM tsk""", "tsk")
oracle("registry_report", """, p AS (SELECT *, '/task/' || person || '/' || k AS path, count(*) OVER (PARTITION BY lower(trim(id))) AS n FROM tsk WHERE k % 71 <> 0)
    SELECT '/task/' || person || '/' || k AS path, 'invalid-json' AS violation FROM tsk WHERE k % 71 = 0
    UNION ALL SELECT path, 'adapter' FROM p WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT path, 'person-directory' FROM p WHERE k % 59 = 0
    UNION ALL SELECT path, 'id-directory' FROM p WHERE k % 61 = 0
    UNION ALL SELECT path, 'id-blank' FROM p WHERE trim(id) = ''
    UNION ALL SELECT path, 'id-trailing-dot' FROM p WHERE id LIKE '%.'
    UNION ALL SELECT path, 'id-unsafe-character' FROM p WHERE contains(id, '/')
    UNION ALL SELECT path, 'blank-task' FROM p WHERE k % 67 = 0
    UNION ALL SELECT path, 'duplicate-id' FROM p WHERE n > 1""", "tsk")
oracle("registry_order", """SELECT k AS task_no, person, CASE WHEN regexp_matches(trim(id), '^[0-9]+$') THEN 0 ELSE 1 END AS kind,
    CASE WHEN regexp_matches(trim(id), '^[0-9]+$') THEN length(trim(id)) ELSE 0 END AS digits, lower(trim(id)) AS key_text,
    row_number() OVER (ORDER BY kind, digits, key_text, person, task_no) - 1 AS ordinal FROM tsk""", "tsk")
oracle("tasks_by_person", """SELECT person, id AS task_id, arg_min(id, (num IS NULL, num, lower(id))) OVER (PARTITION BY person) AS first_task_id,
    count(*) OVER (PARTITION BY person) AS n_tasks FROM (SELECT person, id,
    CASE WHEN regexp_matches(id, '^[0-9]+$') THEN CAST(id AS BIGINT) END AS num FROM tsk)""", "tsk")
oracle("target_resolution", """, t AS (SELECT 'n' || n_nationkey || 'w' || w AS target, n_name AS person, w AS week,
      CASE w WHEN 1 THEN '第一周' ELSE '第二周' END AS label FROM nation, (VALUES (1), (2)) AS x(w)),
    h AS (SELECT target, count(*) AS n, min(trim(id)) AS task_id FROM t JOIN tsk USING (person)
      WHERE trim(id) <> '' AND CASE WHEN explicit <> '' THEN explicit = target
        ELSE text_week = t.week OR tsk.week = t.week::VARCHAR OR tsk.week = label END GROUP BY target)
    SELECT target, person, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status,
    CASE WHEN n = 1 THEN task_id END AS task_id FROM t LEFT JOIN h USING (target)""", "tsk")
oracle("task_targets", """SELECT k AS task_no, target, CASE WHEN target IS NULL THEN CASE WHEN c_nationkey % 6 = 0 THEN 'unknown-person' ELSE 'unknown-week' END END AS target_problem
    FROM (SELECT k, c_nationkey, CASE WHEN explicit <> '' THEN explicit WHEN c_nationkey % 6 = 0 THEN NULL WHEN week = '2' THEN 'n' || c_nationkey || 'w2'
      WHEN week = '9' THEN NULL WHEN text_week > 0 THEN 'n' || c_nationkey || 'w' || text_week END AS target FROM tsk)""", "tsk")
oracle("select_tasks", """WITH w AS (SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 10000000 ELSE 0 END AS task_id FROM orders WHERE o_totalprice > 300000)
    SELECT c_custkey AS task_id, 'selected' AS status FROM customer JOIN nation ON n_nationkey = c_nationkey
      WHERE n_regionkey < 2 AND c_custkey IN (SELECT task_id FROM w)
    UNION ALL SELECT task_id, 'unknown' FROM w WHERE task_id NOT IN (SELECT c_custkey FROM customer)""")
oracle("pending_tasks", """SELECT c_custkey AS case_id, n_name AS person FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey NOT IN (SELECT case_id FROM old WHERE marker = 'complete')""", "old")
oracle("prompt_build", r"""SELECT doc_id, md5(p) AS prompt_md5, length(p) AS n_chars FROM (
    SELECT doc_id, CASE WHEN s = '' OR ends_with(t, s) THEN t ELSE t || chr(10) || s END AS p FROM (
      SELECT doc_id, regexp_replace(text, '[\s\p{Z}]+$', '') AS t, CASE doc_id % 4 WHEN 1 THEN 'Please.' WHEN 2 THEN '.' ELSE '' END AS s FROM documents))""")
oracle("batch_next_version", """WITH u AS (SELECT DISTINCT strftime(o_orderdate, '%m%d') AS mmdd, 1 + o_custkey % 60 AS v FROM orders WHERE month(o_orderdate) <> 6),
    d AS (SELECT mmdd, count(v) AS n_used FROM (SELECT DISTINCT strftime(o_orderdate, '%m%d') AS mmdd FROM orders) LEFT JOIN u USING (mmdd) GROUP BY mmdd),
    f AS (SELECT mmdd, min(i) AS next_version FROM d, range(1, 10000) AS r(i) WHERE i <= n_used + 1
      AND NOT EXISTS (SELECT 1 FROM u WHERE u.mmdd = d.mmdd AND u.v = i) GROUP BY mmdd)
    SELECT mmdd, n_used, next_version, 'weekly-batches-' || mmdd || '-v' || next_version AS name FROM d JOIN f USING (mmdd)""")

# --- text rules -----------------------------------------------------------------------------------

_RULES = {
    "failure": [r"<that>.{0,12}<are>", r"<aux>.{0,3}<un>"],
    "completion": [r"<the>.{0,24}<of>", r"<der>.{0,12}<die>"],
    "courtesy": [r"<and>.{0,20}<in>"],
    "confirmation": [r"<la>", r"<was>.{0,8}<on>"],
    "future_only": [r"<des>", r"<les?>"],
}


def _gap(pattern: str) -> str:
    """Spell `\\b.{0,n}\\b` between two words without look-around: the gap starts and ends outside
    words, so its first and last characters are non-word ones (or it is a single one)."""
    if ">.{0," not in pattern:
        return _word(pattern)
    head, rest = pattern.split(">.{0,")
    n, tail = rest.split("}<")
    nw = r"[^\p{L}\p{N}_]"
    return _word(head) + f"{nw}(.{{0,{int(n) - 2}}}{nw})?" + _word(tail)


def _rule_found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?is){_gap(pattern)}')"


def _any(text: str, group: str) -> str:
    return "(" + " OR ".join(_rule_found(text, p) for p in _RULES[group]) + ")"


def _verdict(text: str) -> str:
    return (f"CASE WHEN {_any(text, 'failure')} THEN 'partial-or-failed' WHEN {_any(text, 'completion')} AND {_any(text, 'courtesy')} "
            f"THEN 'complete' WHEN {_any(text, 'confirmation')} OR {_any(text, 'future_only')} THEN 'needs-confirmation' ELSE 'complete' END")


oracle("reply_verdict", f"""SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'missing-content' ELSE {_verdict('text')} END AS verdict FROM documents""")
oracle("reply_verdict_default", """SELECT conv_id, turn, CASE (conv_id + turn) % 10 WHEN 1 THEN 'partial-or-failed' WHEN 2 THEN 'partial-or-failed'
    WHEN 4 THEN 'needs-confirmation' WHEN 5 THEN 'needs-confirmation' WHEN 6 THEN 'needs-confirmation' WHEN 8 THEN 'needs-confirmation'
    WHEN 9 THEN 'partial-or-failed' ELSE 'complete' END AS verdict FROM conversations""")
oracle("rule_hits", " UNION ALL ".join(
    f"SELECT lang, '{group}' AS rule_group, {i} AS rule_no, count(*) AS n_docs FROM documents WHERE {_rule_found('text', p)} GROUP BY lang"
    for group, ps in _RULES.items() for i, p in enumerate(ps, 1)))
_TEXT_FORMATS = [
    ("docx", r"\.docx>|<docx>|word\s*文档|word\s*文件"), ("html", r"\.html?>|<html?>|网页"), ("pdf", r"\.pdf>|<pdf>"),
    ("xlsx", r"\.xlsx>|<xlsx>|excel\s*(工作簿|文件|表格)"), ("csv", r"\.csv>|<csv>"), ("md", r"\.md>|<markdown>|markdown\s*文件|\.markdown>"),
    ("txt", r"\.txt>|<txt>|纯文本文件"), ("pptx", r"\.pptx>|<pptx>|powerpoint\s*(演示文稿|文件)"), ("doc", r"\.doc>"),
    ("xls", r"\.xls>"), ("ppt", r"\.ppt>"), ("json", r"\.json>"), ("jsonl", r"\.jsonl>"),
]
oracle("required_formats", "SELECT doc_id, array_to_string(list_sort(CASE WHEN len(f) = 0 THEN ['docx', 'html'] ELSE f END), ',') AS formats FROM ("
       "SELECT doc_id, list_filter([" + ", ".join(
           f"CASE WHEN regexp_matches(body, '(?i){_word(p)}') THEN '{name}' END" for name, p in _TEXT_FORMATS)
       + "], lambda x: x IS NOT NULL) AS f FROM (SELECT doc_id, text || ' ' || ['写周报', '生成docx文件', '输出 docx 和 pdf 文件', '保存为 report.md，', "
         "'导出 Word 文档', 'a.doc', 'x.HTM and notes.markdown', 'data.jsonl', 'Excel 表格, PowerPoint文件 及 csv'][doc_id % 9 + 1] AS body FROM documents))")

# --- JSON and commands ----------------------------------------------------------------------------

_RAW = """'{"path":"/p/' || turn || '.md","more":{"Output_Dir":"/o/' || conv_id || '","n":' || turn || '}}'"""
oracle("json_strings", f"""SELECT conv_id, turn, unnest(generate_series(0, 6)) AS pos,
    unnest([role, 't ' || text, {_RAW}, '/p/' || turn || '.md', '/o/' || conv_id, '/s/' || turn, role]) AS value FROM conversations""")
oracle("json_output_keys", """SELECT conv_id, turn, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS value FROM (SELECT conv_id, turn,
    list_concat(CASE WHEN turn % 2 = 0 THEN ['/p/' || turn || '.md'] ELSE [] END, ['/o/' || conv_id, '/s/' || turn]) AS f FROM conversations)""")
oracle("shell_fragments", r"""SELECT event_id, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS fragment FROM (
    SELECT event_id, list_concat(CASE event_id % 6 WHEN 0 THEN [] WHEN 1 THEN ['b' || s] WHEN 2 THEN [s] WHEN 3 THEN [s] WHEN 4 THEN [s]
        ELSE ['w.write_text(''' || s, s] END,
      CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['log'] WHEN 2 THEN ['z'] ELSE ['y'] END) AS f
    FROM (SELECT event_id, event_id || '.txt' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' && tee > log' WHEN 2 THEN ''') --out z'
      ELSE ' -o' || chr(9) || 'y' END AS s FROM events)) WHERE len(f) > 0""")
_EXT = "md|markdown|html?|docx?|pdf|xlsx?|csv|jsonl?|txt|log"
_HINTS = "worklog|work_log|work-log"
_AFTER = r"""(?:$|[\s"''<>`\]),，。；;:：])"""
_MIDDLE = "substr(text, 1, length(text) // 2) || {} || substr(text, length(text) // 2 + 1)"
_MENTIONS = "WITH d AS (SELECT doc_id, " + _MIDDLE.format("""[' ''./my out/', ' res/', ' ''my dir\\', ' ../up/', ' C:/x/',
    ' notes/worklog/', ' saved /out/desk/sub/'][doc_id % 7 + 1] || doc_id || ['.docx'' ', '.CSV, ', '.md''; ', '.pdf; ', '.txt ', ' ',
    '.html] and /out/desk/b.log '][doc_id % 7 + 1]""") + " AS text FROM documents)"
# a bare path starts where a word does and ends at the word's last extension
_RELATIVE = _MENTIONS + rf""", w AS (SELECT *, regexp_split_to_array(text, '[\s"''<>`|;&]+') AS words FROM d),
    f AS (SELECT doc_id, list_concat(
      regexp_extract_all(text, '(?i)["'']([^"'']+\.(?:{_EXT}))["'']', 1),
      list_filter(list_transform(words, lambda x: regexp_extract(x, '(?i)^(.+\.(?:{_EXT})){_AFTER}', 1)), lambda x: x <> ''),
      regexp_extract_all(text, '(?i)["'']([^"'']*(?:{_HINTS})[^"'']*)["'']', 1),
      list_filter(words, lambda x: regexp_matches(x, '(?i){_HINTS}'))) AS f FROM w WHERE text IS NOT NULL) """
oracle("text_relative_paths", _RELATIVE + """SELECT doc_id, unnest(generate_series(0, len(f) - 1)) AS pos, unnest(f) AS found FROM f WHERE len(f) > 0""")
oracle("text_workspace_paths", _RELATIVE + rf""", m AS (SELECT doc_id, unnest(f) AS found FROM f),
    c AS (SELECT *, regexp_replace(trim(replace(trim(trim(found), '`"'''), chr(92), '/')), '[.,;:!?，。；：！？\]}})、]+$', '') AS p FROM m),
    r AS (SELECT *, list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM c),
    j AS (SELECT *, array_to_string(parts, '/') AS rel FROM r)
    SELECT doc_id, found, CASE WHEN doc_id % 13 <> 0 AND NOT regexp_matches(p, '^/|^[A-Za-z]:|://') AND len(parts) > 0 AND NOT list_contains(parts, '..')
      AND (regexp_matches(regexp_extract(rel, '[^/]*$'), '(?i)[^.]\.({_EXT})$') OR regexp_matches(lower(rel), '{_HINTS}|工作日志|工作记录'))
      THEN '/workspace/s' || (doc_id % 9) || '/' || rel END AS remote_path FROM j""")
oracle("text_root_paths", _MENTIONS + rf""", t AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM d),
    r AS (SELECT doc_id, list_concat(CASE WHEN starts_with(s, '/out/desk/sub/') THEN [s] ELSE [] END,
      regexp_extract_all(text, '(?i)(/out/desk/sub[^\r\n"''<>`]*?\.(?:{_EXT})){_AFTER}', 1),
      CASE WHEN starts_with(s, '/out/desk/') THEN [s] ELSE [] END,
      regexp_extract_all(text, '(?i)(/out/desk[^\r\n"''<>`]*?\.(?:{_EXT})){_AFTER}', 1)) AS f FROM t)
    SELECT doc_id, unnest(f) AS found FROM r""")
_MARKER = r"""(?i)(?:>>?|--output(?:=|\s+)|--out(?:=|\s+)|-o\s+|save(?:_as)?\s*\(|write(?:_text|_bytes)?\s*\()\s*["'']?"""
oracle("text_shell_fragments", "WITH c AS (SELECT conv_id, turn, " + _MIDDLE.format("""[' > ''', ' --output=', ' -o  ', ' f.save_as( "',
      ' >>log; g.write ('''][(conv_id + turn) % 5 + 1] || conv_id || '-' || turn || '.txt '""") + f""" AS t FROM conversations),
    p AS (SELECT *, regexp_split_to_array(t, '{_MARKER}') AS gaps, regexp_extract_all(t, '{_MARKER}') AS hits FROM c),
    k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM p)
    SELECT conv_id, turn, i - 1 AS pos, substr(t, (list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + list_sum(list_transform(hits[1:i], lambda x: length(x))) + 1)::BIGINT) AS fragment FROM k""")
oracle("logged_paths_found", """SELECT conv_id AS trace, remote_path, min(label) AS root_label, min(turn) AS first_seen FROM (
    SELECT conv_id, turn, '/desk/' || conv_id || '-' || turn || '.md' AS remote_path, 'Desk' AS label FROM conversations WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, turn, '/workspace/s' || conv_id || '/out/' || conv_id || '.docx', '' FROM conversations WHERE turn % 4 = 1
    UNION ALL SELECT conv_id, turn, '/workspace/s' || conv_id || '/res/' || conv_id || '-' || turn || '.csv', '' FROM conversations WHERE turn % 4 = 2
    UNION ALL SELECT conv_id, turn, '/desk/sub/' || conv_id || '.pdf', 'Sub' FROM conversations WHERE turn % 4 = 3) GROUP BY 1, 2""")

# --- runs -----------------------------------------------------------------------------------------

oracle("present_formats", """SELECT case_id, string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM art WHERE pulled GROUP BY case_id""", "art")
oracle("missing_formats", """, p AS (SELECT case_id, list(DISTINCT format) AS have FROM art WHERE pulled GROUP BY case_id),
    m AS (SELECT o_orderkey AS case_id, list_sort(list_filter(formats, lambda x: NOT list_contains(coalesce(have, []), x))) AS missing
      FROM orders JOIN fmt ON k = o_orderkey % 9 LEFT JOIN p ON case_id = o_orderkey)
    SELECT case_id, array_to_string(missing, ',') AS missing, len(missing) = 0 AS all_present FROM m""", "art", "fmt")
oracle("missing_format_rows", """SELECT format, count(*) AS n_cases FROM (
    SELECT o_orderkey AS case_id, unnest(formats) AS format FROM orders JOIN fmt ON k = o_orderkey % 9
    EXCEPT SELECT case_id, format FROM art WHERE pulled) GROUP BY format""", "art", "fmt")
oracle("pull_counts", """SELECT case_id, count(*) FILTER (pulled AND source = 'report') AS outputs_pulled,
    count(*) FILTER (pulled AND source = 'worklog') AS worklogs_pulled, count(*) FILTER (pulled AND source = 'summary') AS summaries_pulled
    FROM art GROUP BY case_id""", "art")
oracle("run_outcome", "SELECT case_id, outcome, failure_kind FROM flg", "flg")
oracle("failure_distribution", "SELECT outcome, failure_kind, count(*) AS n_runs FROM flg GROUP BY 1, 2", "flg")
_RESULTS = f"""j AS (SELECT tsk.k AS case_id, person, list_sort(CASE WHEN tsk.k % 67 = 0 THEN ['docx', 'html'] ELSE formats END) AS req, coalesce(present, '') AS present,
      coalesce(o, 0) AS o, coalesce(w, 0) AS w, coalesce(s, 0) AS s, reply, coalesce(o_orderstatus = 'P', false) AS broken,
      coalesce(o_orderstatus = 'F' AND o_orderpriority LIKE '1%', false) AS unprepared,
      CASE WHEN unprepared THEN 'not-run' ELSE coalesce(ended, 'timeout') END AS ended, CASE WHEN NOT unprepared THEN session END AS session
      FROM tsk JOIN fmt ON fmt.k = tsk.k % 9 LEFT JOIN a ON a.case_id = tsk.k LEFT JOIN e ON e.case_id = tsk.k LEFT JOIN r ON r.case_id = tsk.k
      LEFT JOIN orders ON o_orderkey = tsk.k),
    q AS (SELECT *, list_filter(req, lambda x: NOT list_contains(string_split(present, ','), x)) AS miss FROM j)
    SELECT case_id, person, array_to_string(req, ',') AS required, present, array_to_string(miss, ',') AS missing, o AS outputs_pulled, w AS worklogs_pulled,
      s AS summaries_pulled, CASE WHEN ended <> 'stop' THEN 'not-started' WHEN reply IS NULL THEN 'missing-content' ELSE {_verdict('reply')} END AS dialog_verdict,
      session AS session_id, CASE WHEN session IS NULL AND ended = 'stop' THEN 1 ELSE 0 END AS n_warnings,
      CASE WHEN unprepared THEN 'failed' WHEN broken THEN 'interrupted'
        WHEN ended <> 'stop' OR len(miss) > 0 OR session IS NULL THEN 'failed' ELSE 'complete' END AS outcome,
      CASE WHEN unprepared THEN 'data-preparation' WHEN broken THEN NULL WHEN ended = 'timeout' THEN 'timeout' WHEN ended = 'error' THEN 'agent-error' WHEN len(miss) > 0 THEN 'missing-deliverables'
        WHEN session IS NULL THEN 'execution-error' END AS failure_kind FROM q"""
oracle("run_result", f""", a AS (SELECT case_id, coalesce(string_agg(DISTINCT format, ',' ORDER BY format) FILTER (pulled AND source = 'report'), '') AS present,
      count(*) FILTER (pulled AND source = 'report') AS o, count(*) FILTER (pulled AND source = 'worklog') AS w,
      count(*) FILTER (pulled AND source = 'summary') AS s FROM art GROUP BY case_id),
    e AS (SELECT trace AS case_id, CASE WHEN ended_at < started + INTERVAL 1 DAY THEN reason ELSE 'timeout' END AS ended, session FROM (
      SELECT trace, min(ts) AS started, arg_min(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS reason,
      arg_min(ts, n) FILTER (role = 'main' AND reason <> 'tool_use') AS ended_at,
      coalesce(arg_min(session, n) FILTER (role = 'main' AND session IS NOT NULL), arg_min(session, n) FILTER (session IS NOT NULL)) AS session
      FROM tr GROUP BY trace)),
    r AS (SELECT conv_id AS case_id, arg_max(text || '!', turn) FILTER (role = 'assistant' AND turn % 5 <> 4) AS reply FROM conversations GROUP BY 1),
    """ + _RESULTS, "art", "fmt", "tr", "tsk")
_CHAIN = """, x AS (SELECT trace, n, ts, role, reason, session, NULL AS reply FROM tr WHERE NOT bad
      UNION ALL SELECT conv_id, 1000000000000 + turn, NULL, CASE role WHEN 'system' THEN 'sub' ELSE 'main' END,
        CASE role WHEN 'user' THEN 'tool_use' ELSE 'stop' END, 'c' || conv_id, CASE WHEN turn % 5 <> 4 THEN text || '!' END FROM conversations),
    t AS (SELECT trace AS case_id, min(ts) AS started, arg_min(reason, n) FILTER (role = 'main' AND reason <> 'tool_use') AS reason,
      min({'n': n, 'at': ts}) FILTER (role = 'main' AND reason <> 'tool_use') AS ended,
      coalesce(arg_min(session, n) FILTER (role = 'main' AND session IS NOT NULL), arg_min(session, n) FILTER (session IS NOT NULL)) AS session,
      arg_max(reply, n) FILTER (role = 'main' AND reason = 'stop' AND reply IS NOT NULL) AS reply FROM x GROUP BY trace),
    e AS (SELECT case_id, session, CASE WHEN reason IS NULL OR ended['at'] >= started + INTERVAL 1 DAY THEN 'timeout' ELSE reason END AS ended FROM t),
    r AS (SELECT case_id, reply FROM t),
    a AS (SELECT case_id, coalesce(string_agg(DISTINCT format, ',' ORDER BY format) FILTER (pulled AND source = 'report'), '') AS present,
      count(*) FILTER (pulled AND source = 'report') AS o, count(*) FILTER (pulled AND source = 'worklog') AS w,
      count(*) FILTER (pulled AND source = 'summary') AS s FROM art JOIN e USING (case_id)
      WHERE session IS NOT NULL AND (source <> 'report' OR session = 's' || (size % 11)) GROUP BY case_id),
    """ + _RESULTS + " WHERE case_id % 4 <> 0"
oracle("chain_results", _CHAIN, "art", "fmt", "tr", "tsk")
oracle("chain_totals", ", found AS (" + "WITH " + _CHAIN.lstrip(", ") + """),
    m AS (SELECT case_id, yr AS attempt, marker FROM led UNION ALL SELECT case_id, 9999, outcome FROM found),
    st AS (SELECT c_custkey AS case_id, n_name AS person, c_custkey % 200 AS run_id, CASE WHEN bool_or(marker = 'interrupted') THEN 'interrupted'
        WHEN bool_or(marker = 'failed') THEN 'failed' WHEN bool_or(marker = 'complete') THEN 'complete' ELSE 'not-run' END AS outcome
      FROM customer JOIN nation ON n_nationkey = c_nationkey
      LEFT JOIN (SELECT * FROM m WHERE attempt = (SELECT max(attempt) FROM m p WHERE p.case_id = m.case_id)) m ON m.case_id = c_custkey GROUP BY 1, 2, 3),
    re AS (SELECT run_id, run_id % 9 <> 0 AND bool_and(st.outcome IN ('failed', 'interrupted')
        OR st.outcome = 'complete' AND coalesce(outputs_pulled > 0 AND session_id IS NOT NULL, false)) AS runner_finished
      FROM st LEFT JOIN found USING (case_id) GROUP BY run_id),
    g AS (SELECT run_id, person, grouping(run_id, person) AS level, count(*) FILTER (outcome = 'complete') AS n_success,
      count(*) FILTER (outcome <> 'complete') AS n_failed FROM st GROUP BY ROLLUP (run_id, person))
    SELECT g.*, n_failed = 0 AS ok, runner_finished FROM g LEFT JOIN re USING (run_id)""", "art", "fmt", "tr", "tsk", "led")
oracle("attempts", """, f AS (SELECT case_id, count(*) AS n, arg_min(marker, (started, run_key)) AS m1,
      first(kind ORDER BY started, run_key) AS k1, arg_max(marker, (started, run_key)) AS m2, last(kind ORDER BY started, run_key) AS k2 FROM led GROUP BY case_id),
    g AS (SELECT *, coalesce(m1 = 'failed' AND k1 IN ('timeout', 'agent-error'), false) AS eligible FROM f)
    SELECT case_id, n AS n_attempts, k1 AS first_failure_kind, m2 AS final_marker, k2 AS final_failure_kind, eligible AS retry_eligible,
      eligible AND n > 1 AND m2 = 'complete' AS retry_recovered, n > 2 OR (n > 1 AND NOT eligible) AS policy_violation FROM g""", "led")
oracle("current_attempts", """SELECT case_id, count(*) AS n_rows, max(run_key) AS last_key FROM led l
    WHERE yr = (SELECT max(yr) FROM led x WHERE x.case_id = l.case_id) GROUP BY case_id""", "led")
oracle("stop_on_error", """WITH o AS (SELECT o_custkey % 7 AS batch, o_custkey AS person, o_orderkey AS task_no, o_orderdate,
      o_orderstatus = 'F' AND o_custkey % 100 > 60 AS failed FROM orders),
    s AS (SELECT batch, min(person) AS stop FROM o WHERE failed GROUP BY batch)
    SELECT batch, person, task_no, before = 0 AND person <= coalesce(stop, 9000000000) AS executed FROM (
      SELECT *, coalesce(sum(CASE WHEN failed THEN 1 ELSE 0 END)
      OVER (PARTITION BY person ORDER BY o_orderdate, task_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
    LEFT JOIN s USING (batch)""")
oracle("task_status", "SELECT case_id, person, outcome AS execution_outcome FROM sta", "sta")
oracle("batch_ready", """SELECT bat.run_id, count(case_id) AS n_tasks, bat.run_id % 9 <> 0 AND coalesce(bool_and(ready), true) AS runner_finished
    FROM bat LEFT JOIN ent USING (run_id) GROUP BY bat.run_id""", "bat", "ent")
oracle("batch_rollup", """SELECT yr AS run_id, n_name AS person, grouping(yr, n_name) AS level, count(*) FILTER (marker = 'complete') AS n_success,
    count(*) FILTER (marker <> 'complete') AS n_failed, count(*) FILTER (marker <> 'complete') = 0 AS ok
    FROM led JOIN customer ON c_custkey = case_id JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (yr, n_name)""", "led")
_META = """SELECT user_id AS case_id, CASE event_type WHEN 'view' THEN 'remote_log' WHEN 'click' THEN 'session_id'
      WHEN 'signup' THEN 'dialog_verdict' WHEN 'purchase' THEN 'dialog_round' ELSE 'free_note' END AS field,
    CASE WHEN max(event_id) % 4 <> 0 THEN 'v' || max(event_id) END AS value, max(event_id) AS seq FROM events GROUP BY ALL"""
oracle("meta_merge", _META)
oracle("meta_kept", _META)
_SECTION = "CASE source WHEN 'report' THEN 'outputs' WHEN 'worklog' THEN 'worklogs' ELSE 'summaries' END"
oracle("manifest", f"""SELECT case_id, {_SECTION} AS section, lower(stem || ext) AS text, stem || ext AS path,
    CASE WHEN pulled THEN 'pulled' ELSE 'failed' END AS status, size FROM art""", "art")
oracle("manifest_headers", """SELECT o_orderkey AS case_id, o_custkey::VARCHAR AS task_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'log' ELSE 'listing' END AS selection_source, '/workspace/s' || o_orderkey AS session_root,
    count(*) FILTER (source = 'report') AS n_outputs, count(*) FILTER (source = 'worklog') AS n_worklogs,
    count(*) FILTER (source = 'summary') AS n_summaries FROM orders LEFT JOIN art ON case_id = o_orderkey GROUP BY o_orderkey, o_custkey""", "art")
oracle("folder_manifest", """SELECT case_id, CASE source WHEN 'report' THEN 'Desk' ELSE 'Papers' END AS folder,
    lower('/docs/' || source || stem || ext) AS text, '/docs/' || source || stem || ext AS remote_path,
    CASE WHEN pulled THEN 'pulled' ELSE 'failed' END AS status,
    CASE WHEN pulled THEN 'outputs/' || CASE source WHEN 'report' THEN 'Desk/' ELSE 'Papers/' END || substr(stem, 4) || ext END AS local_path
    FROM art WHERE source <> 'worklog'""", "art")
oracle("handoff", """, h AS (SELECT bat.run_id, bat.run_id % 9 <> 0 AND coalesce(bool_and(ready), true) AS runner_finished, count(case_id) AS n_tasks
      FROM bat LEFT JOIN ent USING (run_id) GROUP BY bat.run_id)
    SELECT run_id, CASE WHEN case_id IS NOT NULL THEN row_number() OVER (PARTITION BY run_id ORDER BY case_id) - 1 END AS ordinal,
    runner_finished, n_tasks, CASE WHEN case_id IS NOT NULL THEN 0 END AS kind, length(case_id::VARCHAR) AS digits,
    case_id::VARCHAR AS key_text, coalesce(case_id || '|' || outcome || '|' || CASE WHEN has_trace THEN '/run/' || case_id || '/trace.jsonl' ELSE '-' END || '|' ||
      CASE WHEN outcome <> 'not-run' THEN '/run/' || case_id || '/marker.json' ELSE '-' END || '|/run/' || case_id, '-|-') AS entry
    FROM h LEFT JOIN ent USING (run_id)""", "bat", "ent")
