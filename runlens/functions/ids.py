"""Identifier rules: safe ids, safe session ids, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import strip_ws

_UNSAFE_ID = "[" + re.escape(fv.UNSAFE_ID_CHARS) + "]"


def safe_id(raw: Column) -> Column:
    """Trimmed id."""
    return strip_ws(raw)


def id_problem(raw: Column, json_type: Column | None = None) -> Column:
    """Reason an id cannot name a directory; null when it is safe.

    `json_type` is the JSON type of the value where it is known (`schema_of_variant`): anything
    other than a string or an integer is refused.
    """
    text = safe_id(raw)
    checks = F.when(raw.isNull(), "wrong-type")
    if json_type is not None:
        # integers beyond 64 bits are decimals without a fraction
        checks = checks.when(~json_type.rlike(r"^(STRING|BIGINT|DECIMAL\(\d+,0\))$"), "wrong-type")
    return (
        checks.when(text == "", "blank")
        .when(F.contains(text, F.lit("..")), "parent-reference")
        .when(F.endswith(text, F.lit(".")), "trailing-dot")
        .when(text.rlike(_UNSAFE_ID), "unsafe-character")
        .when(text.rlike(r"[\x00-\x1f]"), "control-character")
    )


def session_id_problem(raw: Column) -> Column:
    """Reason a session id cannot name a workspace directory; null when it is safe."""
    text = strip_ws(F.coalesce(raw, F.lit("")))
    return (
        F.when(text == "", "blank")
        .when((text == ".") | F.contains(text, F.lit("..")), "parent-reference")
        .when(text.rlike(r"[/\\]"), "path-separator")
    )


def natural_key(raw: Column) -> Column:
    """Sort key: numbers first, by value at any length, then text without regard to case."""
    text = safe_id(raw)
    numeric = text.rlike(r"^[0-9]+$")
    digits = F.regexp_replace(text, "^0+(?=.)", "")
    return F.struct(
        F.when(numeric, 0).otherwise(1).alias("kind"),
        F.when(numeric, F.length(digits)).otherwise(0).alias("digits"),
        F.when(numeric, digits).otherwise(F.lower(text)).alias("text"),
    )
