"""Plan shape of every registered query: no pairwise joins, no global windows, pruned scans."""

import re

import pytest

from runlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join_or_global_window(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # a window always has a partition column; `Window [...], [a#1], [...]`
    for spec in re.findall(r"Window(?:GroupLimit)? \[.*", text):
        assert "windowspecdefinition(" not in spec or re.search(r"windowspecdefinition\((?!\w+#\d+L? (?:ASC|DESC))", spec), spec


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["trace_terminal"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert text.count("Exchange") == 1 and "HashAggregate" in text and "SortAggregate" not in text


def test_date_filter_is_pushed_down(spark):
    text = plan(QUERIES["snapshot_diff"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts", text)


def test_last_n_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["trace_recent_terminal"](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_path_candidates_read_their_input_once(spark):
    text = plan(QUERIES["logged_paths_found"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1 and "Union" not in text
