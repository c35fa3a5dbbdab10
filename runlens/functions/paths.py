"""Path rules as native columns: predicates, clean-up, workspace mapping, paths in free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv
from runlens.functions.text import let, path_suffix, strip_ws


def _any_contains(c: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def is_worklog_path(path: Column) -> Column:
    return _any_contains(F.lower(path), fv.WORKLOG_HINTS)


def is_excluded_path(path: Column) -> Column:
    return _any_contains(path, fv.EXCLUDED_SEGMENTS)


def has_logged_extension(path: Column) -> Column:
    return path_suffix(path).rlike(rf"(?i)^\.(?:{fv.LOGGED_EXTENSIONS})$")


def _unquote(c: Column) -> Column:
    return F.btrim(strip_ws(c), F.lit("`\"'"))


def clean_absolute(path: Column) -> Column:
    """Path as a user wrote it, without quotes, file scheme and trailing punctuation."""
    return F.rtrim(F.regexp_replace(_unquote(path), "^file://", ""), F.lit(fv.ABSOLUTE_TRAILING))


def clean_relative(path: Column) -> Column:
    """As `clean_absolute` for relative paths: forward slashes, and its own punctuation set."""
    slashes = F.replace(_unquote(path), F.lit("\\"), F.lit("/"))
    return F.rtrim(strip_ws(slashes), F.lit(fv.RELATIVE_TRAILING))


def workspace_path(
    logged_path: Column, session_id: Column, workspace_root: str = fv.WORKSPACE_ROOT
) -> Column:
    """Location of a tool-relative path inside its session workspace; null when it is refused."""
    prefix = F.concat(F.lit(workspace_root.rstrip("/") + "/"), session_id, F.lit("/"))

    def locate(path: Column, parts: Column) -> Column:
        relative = F.array_join(parts, "/")
        usable = (
            (F.coalesce(session_id, F.lit("")) != "")
            & ~F.startswith(_unquote(logged_path), F.lit("file://"))
            & ~path.rlike(r"^/|^[A-Za-z]:|://")
            & (F.size(parts) > 0)
            & ~F.array_contains(parts, "..")
            & (has_logged_extension(relative) | is_worklog_path(relative))
        )
        return F.when(usable, F.concat(prefix, relative))

    return let(clean_relative(logged_path), lambda path: let(
        F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), lambda parts: locate(path, parts)
    ))


def safe_relative(path: Column, root_path: Column, root_label: Column) -> Column:
    """Path below its root without empty, `.` and `..` parts, under the root's label."""
    below = F.when(
        F.startswith(path, F.concat(root_path, F.lit("/"))),
        F.substring(path, F.length(root_path) + 2, F.length(path)),
    ).otherwise(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1))
    parts = F.filter(F.split(below, "/"), lambda p: ~p.isin("", ".", ".."))
    label = F.filter(F.array(F.coalesce(root_label, F.lit(""))), lambda p: p != "")
    return F.array_join(F.concat(label, parts), "/")


def absolute_paths_in(text: Column, roots: Sequence[str]) -> Column:
    """Paths below any known root that a text mentions, in root order (longest root first).

    A text that is itself such a path counts whole; every mention that ends in a logged extension
    counts up to that extension. `roots` is configuration: each adds one regex.
    """
    stripped = strip_ws(text)
    found = []
    for root in sorted((r.rstrip("/") for r in roots), key=len, reverse=True):
        whole = (stripped == root) | F.startswith(stripped, F.lit(root + "/"))
        found.append(F.when(whole, F.array(stripped)).otherwise(F.array().cast("array<string>")))
        pattern = (
            f"(?iU){_quote(root)}[^\\r\\n\"'<>`]*?\\.(?:{fv.LOGGED_EXTENSIONS}){fv.AFTER_PATH}"
        )
        found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.concat(*found) if found else F.array().cast("array<string>")


def relative_paths_in(text: Column) -> Column:
    """Quoted files, bare files, quoted and bare work-log directories, in that order."""
    return F.concat(
        *[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in fv.RELATIVE_PATH_PATTERNS]
    )


def shell_output_starts(command: Column) -> Column:
    """0-based positions in a command where an output target may start."""
    marker = "(?iU)" + fv.SHELL_OUTPUT_MARKER
    between = F.transform(F.split(command, marker, -1), F.length)
    markers = F.transform(F.regexp_extract_all(command, F.lit(marker), F.lit(0)), F.length)
    steps = let(markers, lambda m: F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda b, k: b + k))
    # running sum kept as an array: the last element is the position reached so far
    return F.aggregate(
        steps,
        F.array().cast("array<int>"),
        lambda acc, step: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + step),
    )


def shell_output_fragments(command: Column) -> Column:
    """Rest of the command after every redirect, output option, save( or write( marker."""
    return F.transform(
        shell_output_starts(command),
        lambda start: F.substring(command, start + 1, F.length(command)),
    )


def _quote(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"
