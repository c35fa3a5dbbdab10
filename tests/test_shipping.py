"""The package works from a folder that does not hold it, on workers that cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from runlens.functions.json_walk import json_strings
from runlens.session import build_session
from runlens.sources.traces import read_trace_lines
spark = build_session("ship", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("STRINGS", spark.createDataFrame([('{{"a": ["x"]}}',)], "j string").select(json_strings(F.col("j"))).first()[0])
print("LINES", read_trace_lines(spark, {traces!r}).count())
"""


def test_from_an_empty_folder(tmp_path):
    (tmp_path / "work").mkdir()
    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "t.jsonl").write_text('{"event": "x"}\n{"event": "y"}\n')
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(repo=str(REPO), traces=str(tmp_path / "traces"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "work", env=env, capture_output=True, text=True, timeout=180)
    assert "STRINGS ['x']" in done.stdout and "LINES 2" in done.stdout, done.stderr[-2000:]
