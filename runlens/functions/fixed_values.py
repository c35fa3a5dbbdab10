"""Fixed values that results depend on. Plain data, in natural order; no logic here."""

# --- Fixed values: operating parameters -----------------------------------------------------
TASK_TIMEOUT_SECONDS = 1800
STABLE_CHECKS = 2
RECENT_MODEL_OUTPUTS = 300
STOP_COUNT_MODEL_OUTPUTS = 10000
MAX_ATTEMPTS = 2
MAX_BATCH_VERSION = 9999
TASK_ADAPTER = "weekly-report"
BATCH_PREFIX = "weekly-batches"
HANDOFF_VERSION = 1

# --- Fixed values: whitespace (every Unicode space and separator) -----------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: event vocabulary ---------------------------------------------------------
MAIN_ROLE = "main"
MODEL_OUTPUT = "model_output"
TOOL_CALL = "tool_call"
TOOL_RESULT = "tool_result"
TERMINAL_REASONS = ("stop", "error")
SHELL_TOOLS = ("bash", "shell", "exec")
WRITE_TOOL_HINTS = ("write", "create", "save", "export", "document", "docx", "worklog")

# --- Fixed values: outcome vocabulary -------------------------------------------------------
MARKER_PRECEDENCE = ("interrupted", "failed", "complete")
RETRYABLE_FAILURES = ("timeout", "agent-error")

# --- Fixed values: listing markers ----------------------------------------------------------
WORKLOG_MARKER = "__WORKLOG__"
SUMMARY_MARKER = "__SUMMARY__"
END_MARKER = "__END__"
TRACE_SUFFIX = ".jsonl"

# --- Fixed values: workspace layout (root is a parameter of every operator that needs it) ---
WORKSPACE_ROOT = "/workspace"
WORKLOG_RELATIVE_ROOT = "memory/weekly-work-report/worklog"
SUMMARY_RELATIVE_ROOT = "memory/weekly-work-report/summary"

# --- Fixed values: path rules ---------------------------------------------------------------
LOGGED_EXTENSIONS = "md|markdown|html?|docx?|pdf|xlsx?|csv|jsonl?|txt|log"
WORKLOG_HINTS = ("worklog", "work_log", "work-log", "工作日志", "工作记录")
AFTER_PATH = r"""(?=$|[\s\"'<>`\]),，。；;:：])"""
RELATIVE_PATH_PATTERNS = (
    r"""[\"']([^\"']+\.(?:md|markdown|html?|docx?|pdf|xlsx?|csv|jsonl?|txt|log))[\"']""",
    r"""(?<![\w./-])([^\s\"'<>`|;&]+\.(?:md|markdown|html?|docx?|pdf|xlsx?|csv|jsonl?|txt|log))(?=$|[\s\"'<>`\]),，。；;:])""",
    r"""[\"']([^\"']*(?:worklog|work_log|work-log)[^\"']*)[\"']""",
    r"""(?<![\w./-])([^\s\"'<>`|;&]*(?:worklog|work_log|work-log)[^\s\"'<>`|;&]*)""",
)
EXCLUDED_SEGMENTS = ("工作快捷区", "文件输出")
ABSOLUTE_TRAILING = ".,;:!?，。；：！？)]}》"
RELATIVE_TRAILING = ".,;:!?，。；：！？]})、"
OUTPUT_PATH_KEYS = (
    "filepath", "outputpath", "outputdir", "savedir", "savepath", "savedpath",
    "destinationpath", "targetpath", "directory", "folder", "worklogdir",
)
SHELL_OUTPUT_MARKER = (
    r"(?:>>?|--output(?:=|\s+)|--out(?:=|\s+)|-o\s+|"
    r"save(?:_as)?\s*\(|write(?:_text|_bytes)?\s*\()\s*[\"']?"
)
UNSAFE_ID_CHARS = r'<>:"/\|?*'

# --- Fixed values: reply rules --------------------------------------------------------------
FAILURE_RULES = (
    r"无法(?:完成|生成|保存|创建|读取)",
    r"暂时(?:无法|不能)",
    r"(?:生成|保存|创建|读取|执行).{0,12}失败",
    r"未能(?:完成|生成|保存|创建|读取)",
    r"需要手动处理",
    r"请(?:重新)?提供.{0,20}(?:文件|数据|权限|信息)",
    r"尚未完成|未完成的部分",
)
COMPLETION_RULES = (
    r"(?:周报|日报|报告|worklog|工作日志|工作记录).{0,24}(?:已|已经)(?:生成|创建|保存|完成)",
    r"(?:已|已经)(?:生成|创建|保存|完成).{0,24}(?:周报|日报|报告|worklog|工作日志|工作记录)",
    r"(?:任务|处理).{0,12}(?:已完成|已经完成|完成成功)",
)
COURTESY_RULES = (
    r"(?:还有|有).{0,20}(?:其他|其它).{0,20}(?:需要|可以|帮忙)",
    r"是否还需要(?:我)?.{0,24}(?:处理|协助|帮忙|调整|修改)",
    r"如(?:还)?需(?:要)?.{0,24}(?:处理|协助|调整|修改).{0,8}(?:请告诉我|请告知)",
)
CONFIRMATION_RULES = (
    r"请.{0,20}确认",
    r"请.{0,12}(?:授权|允许)",
    r"需要.{0,20}确认",
    r"需要(?:你|您)?(?:授权|允许|选择)",
    r"确认后.{0,30}(?:继续|生成|创建|保存|执行|读取|访问)",
    r"是否.{0,30}(?:继续|生成|创建|保存|执行|读取|访问|使用|授权|允许)",
    r"(?:要不要|是否要).{0,30}(?:继续|生成|创建|保存|执行|读取)",
    r"(?:可以|能否).{0,30}(?:开始|继续|生成|创建|保存|执行|读取|访问).{0,8}[吗么？?]",
    r"请选择(?:方案|格式|范围|方式)?",
    r"(?:你|您).{0,10}(?:倾向|选择|希望采用|想选)",
)
FUTURE_ONLY_RULES = (
    r"(?:准备|接下来|下一步|将会|将要).{0,20}(?:生成|创建|保存|整理|读取)",
    r"待确认|等待确认",
)

# --- Fixed values: deliverable formats ------------------------------------------------------
FORMAT_RULES = (
    ("docx", r"(?:\.docx\b|\bdocx\b|Word\s*文档|Word\s*文件)"),
    ("html", r"(?:\.html?\b|\bhtml?\b|网页(?:文件|格式)?)"),
    ("pdf", r"(?:\.pdf\b|\bpdf\b)"),
    ("xlsx", r"(?:\.xlsx\b|\bxlsx\b|Excel\s*(?:工作簿|文件|表格))"),
    ("csv", r"(?:\.csv\b|\bcsv\b)"),
    ("md", r"(?:\.md\b|\bmarkdown\b|Markdown\s*文件)"),
    ("txt", r"(?:\.txt\b|\btxt\b|纯文本文件)"),
    ("pptx", r"(?:\.pptx\b|\bpptx\b|PowerPoint\s*(?:演示文稿|文件))"),
)
# Lower-case substrings of which every match of the rule above contains at least one; \u017f is
# the long s, which matches an s when case is ignored.
FORMAT_HINTS = {
    "docx": ("docx", "word"),
    "html": ("htm", "网页"),
    "pdf": ("pdf",),
    "xlsx": ("xl", "excel"),
    "csv": ("csv", "c\u017fv"),
    "md": ("md", "markdown"),
    "txt": ("txt", "纯文本文件"),
    "pptx": ("pptx", "power"),
}
EXTENSION_HINTS = ("doc", "htm", "pdf", "xl", "csv", "c\u017fv", "md", "markdown", "json", "j\u017fon", "txt", "ppt")
EXPLICIT_EXTENSION = r"\.(docx?|html?|pdf|xlsx?|csv|md|markdown|jsonl?|txt|pptx?)\b"
FORMAT_ALIASES = (("htm", "html"), ("markdown", "md"))
DEFAULT_FORMATS = ("docx", "html")

# --- Fixed values: target codes -------------------------------------------------------------
TARGETS = (
    ("z1", "zhouzeyu", 3),
    ("z2", "zhouzeyu", 2),
    ("s1", "苏晚", 1),
    ("s2", "苏晚", 2),
    ("t1", "唐可", 1),
    ("t2", "唐可", 2),
    ("c1", "陈景明", 1),
    ("c2", "陈景明", 2),
    ("f1", "方一诺", 1),
    ("f2", "方一诺", 2),
)
TARGET_WEEK_LABELS = ((1, "第一周"), (2, "第二周"), (3, "firstweek"))
PERSON_PREFIXES = (
    ("周泽宇", "z"),
    ("苏晚", "s"),
    ("唐可", "t"),
    ("陈景明", "c"),
    ("方一诺", "f"),
)
TASK_WEEK_LABELS = ((1, "第一周"), (2, "第二周"))
