"""Text rules as native columns: trimming, prompts, reply verdicts, requested formats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions import fixed_values as fv

# `U` makes \b, \w, \s and letter case follow Unicode, `s` lets a dot cross line breaks.
_RULE_FLAGS = "(?isU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body mentions it.

    Spark may otherwise repeat a long expression at each mention, regexes and JSON parsing included.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c: Column) -> Column:
    """Trim all Unicode whitespace on both sides (a plain `trim` removes spaces only)."""
    return F.btrim(c, F.lit(fv.WHITESPACE))


def rstrip_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(fv.WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip_ws(c), F.lit("")) == ""


def any_rule(c: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern is found; one alternation, so the text is scanned by one regex."""
    if not patterns:
        return F.lit(False)
    return c.rlike(_RULE_FLAGS + "|".join(f"(?:{p})" for p in patterns))


@dataclass(frozen=True)
class ReplyRules:
    """Ordered rule groups of the reply classifier; any language can be plugged in."""

    failure: Sequence[str] = fv.FAILURE_RULES
    completion: Sequence[str] = fv.COMPLETION_RULES
    courtesy: Sequence[str] = fv.COURTESY_RULES
    confirmation: Sequence[str] = fv.CONFIRMATION_RULES
    future_only: Sequence[str] = fv.FUTURE_ONLY_RULES

    def groups(self) -> dict[str, Sequence[str]]:
        return {
            "failure": self.failure,
            "completion": self.completion,
            "courtesy": self.courtesy,
            "confirmation": self.confirmation,
            "future_only": self.future_only,
        }


def reply_verdict(reply: Column, rules: ReplyRules = ReplyRules()) -> Column:
    """Verdict of a final reply. Failure wins, a courtesy question after completion is complete,
    an open question or a mere announcement needs confirmation, everything else is complete."""
    return let(
        strip_ws(F.coalesce(reply, F.lit(""))),
        lambda text: F.when(text == "", "missing-content")
        .when(any_rule(text, rules.failure), "partial-or-failed")
        .when(any_rule(text, rules.completion) & any_rule(text, rules.courtesy), "complete")
        .when(any_rule(text, [*rules.confirmation, *rules.future_only]), "needs-confirmation")
        .otherwise("complete"),
    )


def rules_hit(text: Column, rules: ReplyRules = ReplyRules()) -> Column:
    """Array of the rules found in a text, each as struct(rule_group, rule_no)."""

    def hits(body: Column) -> Column:
        return F.array(*[
            F.when(
                body.rlike(_RULE_FLAGS + pattern),
                F.struct(F.lit(group).alias("rule_group"), F.lit(i).alias("rule_no")),
            )
            for group, patterns in rules.groups().items()
            for i, pattern in enumerate(patterns, 1)
        ])

    return F.filter(let(strip_ws(F.coalesce(text, F.lit(""))), hits), lambda h: h.isNotNull())


def normalize_format(extension: Column) -> Column:
    """Lower-case, drop the leading dots, fold the two aliases; other names stay."""
    return _fold_alias(F.ltrim(F.lower(extension), F.lit(".")))


def _fold_alias(name: Column) -> Column:
    folded = name
    for alias, target in fv.FORMAT_ALIASES:
        folded = F.when(name == alias, target).otherwise(folded)
    return folded


def _extension(path: Column, use: Callable[[Column], Column]) -> Column:
    """`use(extension)` for a path with one, else ''; a leading-dot name or a trailing dot has none."""
    # cheap functions only: generated code computes the repeated parts once, without a lambda
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    ext = F.substring_index(name, ".", -1)
    return F.when((ext != "") & (F.length(name) > F.length(ext) + 1), use(ext)).otherwise("")


def path_suffix(path: Column) -> Column:
    """Extension with its dot, '' for none."""
    return _extension(path, lambda ext: F.concat(F.lit("."), ext))


def path_format(path: Column) -> Column:
    """Normalised format of a path's extension, '' for none."""
    return _extension(path, lambda ext: _fold_alias(F.lower(ext)))


def requested_formats(
    text: Column,
    rules: Sequence[tuple[str, str]] = fv.FORMAT_RULES,
    explicit: str = fv.EXPLICIT_EXTENSION,
    default: Sequence[str] = fv.DEFAULT_FORMATS,
) -> Column:
    """Sorted distinct formats a task text asks for; the default pair when it names none."""

    def hinted(lowered: Column, hints: Sequence[str] | None) -> Column:
        if hints is None:
            return F.lit(True)
        found = F.lit(False)
        for hint in hints:
            found = found | F.contains(lowered, F.lit(hint))
        return found

    def found_in(body: Column, lowered: Column) -> Column:
        # a substring test on the lower-cased text spares most texts the regex
        named = F.array(*[
            F.when(hinted(lowered, fv.FORMAT_HINTS.get(name) if known else None) & body.rlike("(?iU)" + pattern), name)
            for name, pattern in rules
        ])
        spelled = F.when(
            hinted(lowered, fv.EXTENSION_HINTS if known else None),
            F.transform(F.regexp_extract_all(body, F.lit("(?iU)" + explicit), F.lit(1)), normalize_format),
        ).otherwise(F.array().cast("array<string>"))
        both = F.filter(F.concat(named, spelled), lambda x: x.isNotNull())
        return F.array_sort(F.array_distinct(both))

    known = rules is fv.FORMAT_RULES and explicit is fv.EXPLICIT_EXTENSION
    otherwise = F.array(*[F.lit(x) for x in sorted(default)])
    found = let(
        F.coalesce(text, F.lit("")), lambda body: let(F.lower(body), lambda lowered: found_in(body, lowered))
    )
    return let(found, lambda formats: F.when(F.size(formats) > 0, formats).otherwise(otherwise))


def target_items(value: Column) -> Column:
    """Lower-cased items of a list typed with commas (ASCII or full-width) or whitespace."""
    items = F.split(strip_ws(value), r"(?U)[,，\s]+")
    return F.filter(F.transform(items, F.lower), lambda x: x != "")


def execution_prompt(task: Column, suffix: Column | str | None) -> Column:
    """Task text without trailing whitespace, plus the suffix on a new line if it is missing."""
    body = rstrip_ws(task)
    tail = strip_ws(F.coalesce(F.lit(suffix) if not isinstance(suffix, Column) else suffix, F.lit("")))
    return F.when((tail == "") | F.endswith(body, tail), body).otherwise(F.concat_ws("\n", body, tail))


def prompt_problem(content: Column) -> Column:
    """Why raw prompt bytes are unusable: invalid-utf8, blank or nul-character; null when fine."""
    text = prompt_text(content)
    return (
        F.when(~F.is_valid_utf8(content.cast("string")), "invalid-utf8")
        .when(is_blank(text), "blank")
        .when(F.contains(text, F.lit("\u0000")), "nul-character")
    )


def prompt_text(content: Column) -> Column:
    """Prompt text without a byte-order mark."""
    return F.regexp_replace(content.cast("string"), "^\ufeff", "")


def iso_timestamp(text: Column) -> Column:
    """Instant of an ISO-8601 date or date-time, `Z` allowed; null for anything else."""
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)
    return dated.try_cast("timestamp")


def run_mmdd(run_date: Column) -> Column:
    """MMDD of a YYYYMMDD run date; null when it is not a date."""
    digits = F.when(run_date.rlike(r"^[0-9]{8}$"), run_date)
    return F.date_format(F.try_to_date(digits, "yyyyMMdd"), "MMdd")
