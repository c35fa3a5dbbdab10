"""Output paths that a trace mentions: which strings of an event may hold one, and where it lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.json_walk import json_mentions
from runlens.functions.paths import (
    absolute_paths_in,
    clean_absolute,
    relative_paths_in,
    shell_output_fragments,
    workspace_path,
)
from runlens.functions.text import strip_ws
from runlens.operators.common import Cols, exploded, names, order_key


def _is_write_tool() -> Column:
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    hit = F.lit(False)
    for hint in fv.WRITE_TOOL_HINTS:
        hit = hit | F.contains(tool, F.lit(hint))
    return hit


def candidate_strings(events: DataFrame, trace: str = "trace", order: Cols = "byte_offset") -> DataFrame:
    """Strings that may hold an output path, one row each, with whether relative paths count.

    Model output: every string of the reply, absolute paths only. Write-like tool calls: every
    string of the arguments. Shell calls: what follows an output marker. Tool results: values
    under output keys, and under `path` when the tool is write-like.
    """
    kind = F.lower(F.coalesce("event", F.lit("")))
    tool = F.lower(F.coalesce("tool_name", F.lit("")))
    write = _is_write_tool()
    keys = [trace, *names(order), "session_id"]

    # one scan and one call into Python; shell calls pass it a null and stay native
    reply, call, result = (kind == k for k in (fv.MODEL_OUTPUT, fv.TOOL_CALL, fv.TOOL_RESULT))
    shell = call & ~write & tool.isin(*fv.SHELL_TOOLS)
    walked = json_mentions(
        F.when(~shell, F.col("payload")), result, F.when(call, "args").otherwise("assistant"), reply, write)
    fragments = shell_output_fragments(F.get_json_object("args", "$.command"))
    return exploded(
        events.where(reply | (call & write) | shell | result),
        [*keys, (~reply).alias("relative")],
        F.when(shell, fragments).otherwise(walked), "value", "value_pos",
    )


def logged_output_paths(
    events: DataFrame, roots: dict[str, str], trace: str = "trace", order: Cols = "byte_offset",
    workspace_root: str = fv.WORKSPACE_ROOT,
) -> DataFrame:
    """Distinct output paths per trace: where they lie, as first mentioned, with their root.

    `roots`: label -> absolute path, a configuration value. The first mention of a path wins;
    mentions are ordered by event, string in the event, absolute before relative, place in the
    string. Rows: trace, remote_path, logged_path, root_label, root_path, first_seen.
    """
    by_length = sorted(((p.rstrip("/"), label) for label, p in roots.items()), key=lambda r: -len(r[0]))
    value = F.col("value")
    found = F.concat(
        F.transform(absolute_paths_in(value, [p for p, _ in by_length]), lambda p, i: _mention(0, i, p)),
        F.when(F.col("relative"), F.transform(relative_paths_in(value), lambda p, i: _mention(1, i, p)))
        .otherwise(F.array().cast("array<struct<kind:int,pos:int,logged_path:string>>")),
    )
    session = strip_ws(F.coalesce("session_id", F.lit("")))
    mentions = exploded(
        candidate_strings(events, trace, order), [trace, *names(order), "value_pos", session.alias("_session")], found, "_m"
    ).select(trace, *names(order), "value_pos", "_session", "_m.*")

    path = clean_absolute(F.col("logged_path"))
    absolute_root = F.lit(None).cast("struct<root_label:string,root_path:string>")
    for root, label in reversed(by_length):
        below = (path == root) | F.startswith(path, F.lit(root + "/"))
        absolute_root = F.when(
            below, F.struct(F.lit(label).alias("root_label"), F.lit(root).alias("root_path"))
        ).otherwise(absolute_root)
    own_root = F.concat(F.lit(workspace_root.rstrip("/") + "/"), F.col("_session"))
    mapped = mentions.select(
        trace, *names(order), "value_pos", "kind", "pos", "logged_path",
        F.when(F.col("kind") == 0, F.when(absolute_root.isNotNull(), path))
        .otherwise(workspace_path(F.col("logged_path"), F.col("_session"), workspace_root)).alias("remote_path"),
        F.when(F.col("kind") == 0, absolute_root["root_label"]).otherwise("").alias("root_label"),
        F.when(F.col("kind") == 0, absolute_root["root_path"]).otherwise(own_root).alias("root_path"),
    ).where(F.col("remote_path").isNotNull())

    place = F.struct(order_key(order).alias("o"), "value_pos", "kind", "pos")
    first = F.min_by(F.struct("logged_path", "root_label", "root_path"), place)
    return mapped.groupBy(trace, "remote_path").agg(
        first.alias("_f"), F.min(order_key(order)).alias("first_seen")
    ).select(trace, "remote_path", "_f.*", "first_seen")


def _mention(kind: int, pos: Column, path: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), path.alias("logged_path"))
