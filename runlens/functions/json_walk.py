"""Recursive JSON walks. Spark has no recursive expression without depth limits, so these are
Arrow-batched UDFs over one JSON document each; everything around them is native columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import fixed_values as fv

_STRINGS = T.ArrayType(T.StringType())
_NOT_LETTER = re.compile(r"[^a-z]")


def _nested(text: str):
    """Container held in a string, or None."""
    body = text.strip()
    if body[:1] not in ("{", "["):
        return None
    try:
        return json.loads(body)
    except (ValueError, RecursionError):
        return None


def _nodes(document) -> Iterator[tuple[str, object]]:
    """(key, value) of every value in document order, also inside strings that hold JSON.

    The key is '' except for the direct members of an object. An explicit stack keeps deep
    documents off the Python call stack.
    """
    stack = [("", document)]
    while stack:
        key, value = stack.pop()
        yield key, value
        inner = _nested(value) if isinstance(value, str) else value
        if isinstance(inner, dict):
            stack.extend((str(k), v) for k, v in reversed(inner.items()))
        elif isinstance(inner, list):
            stack.extend(("", v) for v in reversed(inner))


def _strings(raw: str | None, member: str | None = None, or_whole: bool = False) -> list[str] | None:
    if raw is None:
        return None
    try:
        document = json.loads(raw)
    except (ValueError, RecursionError):
        document = raw  # plain text is one string
    if member:
        rest = document if or_whole else None
        document = document.get(member, rest) if isinstance(document, dict) else rest
    return [v for _, v in _nodes(document) if isinstance(v, str)]


def _output_values(raw: str | None, allow_plain_path: bool) -> list[str] | None:
    if raw is None:
        return None
    keys = set(fv.OUTPUT_PATH_KEYS) | ({"path"} if allow_plain_path else set())
    try:
        document = json.loads(raw)
    except (ValueError, RecursionError):
        return []
    return [
        v for k, v in _nodes(document)
        if isinstance(v, str) and _NOT_LETTER.sub("", k.lower()) in keys
    ]


@F.pandas_udf(_STRINGS)
def _json_strings(raw: pd.Series, member: pd.Series, or_whole: pd.Series) -> pd.Series:
    return pd.Series([_strings(r, m, bool(w)) for r, m, w in zip(raw, member, or_whole)])


@F.pandas_udf(_STRINGS)
def _json_output_values(raw: pd.Series, plain: pd.Series) -> pd.Series:
    return pd.Series([_output_values(r, bool(p)) for r, p in zip(raw, plain)])


@F.pandas_udf(_STRINGS)
def _json_mentions(raw: pd.Series, keyed: pd.Series, member: pd.Series, or_whole: pd.Series, plain: pd.Series) -> pd.Series:
    return pd.Series([
        _output_values(r, bool(p)) if k else _strings(r, m, bool(w))
        for r, k, m, w, p in zip(raw, keyed, member, or_whole, plain)])


def json_mentions(raw: Column, keyed: Column, member: Column, or_whole: Column, allow_plain_path: Column) -> Column:
    """`json_output_values` of the rows where `keyed` holds, `json_strings` of the others, by one call."""
    return _json_mentions(raw, keyed, member, or_whole, allow_plain_path)


def json_strings(raw: Column, member: Column | None = None, or_whole: Column | None = None) -> Column:
    """All strings in a JSON document, in document order, descending into JSON kept in strings.

    With a member name only that top-level member is walked; where it is missing, nothing, or the
    whole document if `or_whole` says so.
    """
    member = F.lit(None).cast("string") if member is None else member
    return _json_strings(raw, member, F.lit(False) if or_whole is None else or_whole)


def json_output_values(raw: Column, allow_plain_path: Column | bool = False) -> Column:
    """String values under output-path keys (`path` too where allowed), in document order.

    Keys are compared in lower case without anything but letters."""
    plain = allow_plain_path if isinstance(allow_plain_path, Column) else F.lit(allow_plain_path)
    return _json_output_values(raw, plain)
