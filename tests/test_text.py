import pytest
from pyspark.sql import functions as F

from runlens.functions.ids import id_problem, natural_key, session_id_problem
from runlens.functions.text import (
    execution_prompt, normalize_format, path_suffix, prompt_problem, prompt_text, reply_verdict,
    requested_formats, run_mmdd, rules_hit,
)
from runlens.operators.tasks import normalize_targets


def apply(spark, values, fn, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_reply_verdict(spark):
    cases = {
        None: "missing-content",
        " \n　": "missing-content",
        "周报已生成": "complete",
        "hello": "complete",
        "无法生成周报": "partial-or-failed",
        "周报已生成，但无法保存文件": "partial-or-failed",
        "周报已生成，还有其他需要帮忙的吗？": "complete",
        "是否继续生成周报？": "needs-confirmation",
        "worklog 已保存，是否继续生成 PDF？": "needs-confirmation",
        "WORKLOG 已保存，是否还需要我继续处理？": "complete",
        "接下来将整理数据": "needs-confirmation",
        "生成\n了一点\n失败": "partial-or-failed",
    }
    assert apply(spark, list(cases), reply_verdict) == list(cases.values())


def test_rules_hit(spark):
    [hits] = apply(spark, ["无法生成周报，待确认"], rules_hit)
    assert [(h.rule_group, h.rule_no) for h in hits] == [("failure", 1), ("future_only", 2)]


def test_requested_formats(spark):
    cases = {
        "写周报": ["docx", "html"],
        None: ["docx", "html"],
        "生成docx文件": ["docx", "html"],
        "输出 docx 和 pdf 文件": ["docx", "pdf"],
        "保存为 report.md，": ["md"],
        "导出 Word 文档": ["docx"],
        "Word　文件": ["docx"],
        "a.doc": ["doc"],
        "x.htm": ["html"],
        "data.jsonl": ["jsonl"],
        "A.DOCX, b.markdown": ["docx", "md"],
        "a.pptx b.ppt": ["ppt", "pptx"],
    }
    assert apply(spark, list(cases), requested_formats) == list(cases.values())


def test_formats_and_suffixes(spark):
    assert apply(spark, [".HTM", ".markdown", ".doc", ""], normalize_format) == ["html", "md", "doc", ""]
    assert apply(spark, ["/a/b.c.md", "/a/.md", "/a/b.", "x", "/a.d/b", "/a/b.md/"], path_suffix) == [
        ".md", "", "", "", "", ".md"]


def test_prompt(spark):
    fn = lambda c: execution_prompt(c, " tail \n")
    assert apply(spark, ["do 　\n", "do tail", "x"], fn) == ["do\ntail", "do tail", "x\ntail"]
    assert apply(spark, ["do \n"], lambda c: execution_prompt(c, None)) == ["do"]


def test_prompt_quality(spark):
    raw = [b"\xef\xbb\xbfhi", b"\xff\xfe", b" \n", b"a\x00b", b"ok"]
    assert apply(spark, raw, prompt_problem, "binary") == [None, "invalid-utf8", "blank", "nul-character", None]
    assert apply(spark, raw[:1], prompt_text, "binary") == ["hi"]


def test_run_date(spark):
    assert apply(spark, ["20260715", "20261315", "x", "2026071"], run_mmdd) == ["0715", None, None, None]


def test_ids(spark):
    ids = ["10", " a b ", "", "..", ".", "a/b", "a.", "a\tb", "a*b", "a..b", None]
    assert apply(spark, ids, id_problem) == [
        None, None, "blank", "parent-reference", "trailing-dot", "unsafe-character", "trailing-dot",
        "control-character", "unsafe-character", "parent-reference", "wrong-type"]
    assert apply(spark, ["s1", " ", "a/b", "a\\b", "..", "."], session_id_problem) == [
        None, "blank", "path-separator", "path-separator", "parent-reference", "parent-reference"]


def test_id_type(spark):
    df = spark.createDataFrame([("true", "BOOLEAN"), ("5", "BIGINT"), ("5", "STRING"), ("1.5", "DECIMAL(2,1)")], "v string, t string")
    got = [r[0] for r in df.select(id_problem(F.col("v"), F.col("t"))).collect()]
    assert got == ["wrong-type", None, None, "wrong-type"]


def test_natural_order(spark):
    ids = ["10", "9", "b", "A", "007", "99999999999999999999999999999999999999999999", "0"]
    df = spark.createDataFrame([(v,) for v in ids], "v string")
    got = [r[0] for r in df.orderBy(natural_key(F.col("v"))).collect()]
    assert got == ["0", "007", "9", "10", "9" * 44, "A", "b"]


def test_targets(spark):
    df = spark.createDataFrame([(0, "c1，C2"), (1, " c1 f1")], "pos int, value string").withColumn("l", F.lit(1))
    rows = normalize_targets(df, "l").orderBy("pos", "item_pos").collect()
    assert [r.code for r in rows] == ["c1", "c2", "f1"]


@pytest.mark.parametrize("suffix,expected", [(" ", "a"), ("a", "a"), ("b", "a\nb")])
def test_prompt_suffix_column(spark, suffix, expected):
    df = spark.createDataFrame([("a ", suffix)], "t string, s string")
    assert df.select(execution_prompt(F.col("t"), F.col("s"))).first()[0] == expected
