"""Spans of regular-expression matches as arrays, with built-in functions only.

Spark returns matches without their places. The pieces between them, from `split` with the same pattern, give
the places: a match starts after all earlier pieces and matches. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.llm.common import let, scan_prefix

SPAN = "array<struct<start:bigint,end:bigint,kind:string,text:string,value:string>>"


def find_spans(
    text: Column, kind: str, pattern: str, group: int = 0, keep: Callable[[Column], Column] | None = None,
    hint: Column | None = None,
) -> Column:
    """Leftmost non-overlapping matches of `pattern` that pass `keep`; `value` is the text of `group`.

    `hint` is a cheap condition that holds for every text with a match. Matches must not be empty.
    """
    nothing = F.array().cast(SPAN)

    def placed(hits: Column, gaps: Column, values: Column) -> Column:
        both = F.transform(hits, lambda h, k: (F.char_length(F.get(gaps, k)) + F.char_length(h)).cast("long"))
        return let(scan_prefix(both, 0), lambda before: F.transform(hits, lambda h, k: let(
            F.get(before, k) + F.char_length(F.get(gaps, k)), lambda start: F.struct(
                start.cast("long").alias("start"), (start + F.char_length(h)).cast("long").alias("end"),
                F.lit(kind).alias("kind"), h.alias("text"), F.get(values, k).alias("value")))))

    def found(hits: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        spans = let(F.split(text, pattern, -1), lambda gaps: let(values, lambda v: placed(hits, gaps, v)))
        spans = F.filter(spans, keep) if keep else spans
        return F.when(F.size(hits) == 0, nothing).otherwise(spans.cast(SPAN))

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return F.when(hint, every).otherwise(nothing) if hint is not None else every


def ordered(spans: Column, kinds: tuple[str, ...], by_start: bool) -> Column:
    """Sorted by start, then kind in the order given; or by kind, then start."""
    place = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])

    def key(s: Column) -> Column:
        first, second = (s["start"], place(s)) if by_start else (place(s), s["start"])
        return F.struct(first.alias("a"), second.alias("b"), s.alias("span"))

    return F.transform(F.sort_array(F.transform(spans, key)), lambda x: x["span"])


def _n_below(numbers: Column, bound: Column) -> Column:
    """How many of the ascending `numbers` are below `bound`, by binary search."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda k: k <= F.size(numbers))
    return F.aggregate(steps, F.lit(0), lambda at, k: F.when(
        (at + k <= F.size(numbers)) & (F.get(numbers, at + k - 1) < bound), at + k).otherwise(at))


def apart(spans: Column, others: Column, kinds: tuple[str, ...]) -> Column:
    """Those of `spans` that overlap none of `others`, whose kinds are `kinds`.

    `others` are sorted by start within a kind, and spans of one kind do not overlap each other. Of a kind only
    the last span that starts before a span's end can reach it, so each span costs one binary search a kind.
    """
    def clear(left: Column, kind: str) -> Column:
        def of_kind(own: Column) -> Column:
            return let(F.transform(own, lambda o: o["start"]), lambda starts: F.filter(left, lambda s: let(
                _n_below(starts, s["end"]), lambda n: (n == 0) | (F.get(own, n - 1)["end"] <= s["start"]))))

        return let(F.filter(others, lambda o: o["kind"] == kind), lambda own: F.when(F.size(own) == 0, left).otherwise(of_kind(own)))

    def every(rest: Column, left: tuple[str, ...]) -> Column:
        return let(clear(rest, left[0]), lambda r: every(r, left[1:])) if left else rest

    return let(spans, lambda s: F.when((F.size(s) == 0) | (F.size(others) == 0), s).otherwise(every(s, kinds)))


#: Code points of a block of a text; see `blocks`.
BLOCK = 64


def blocks(text: Column) -> Column:
    """A text in pieces of BLOCK code points, for `cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from `start` to `end` of the text of `blocks`, in time that depends on their number only."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substr(near, (start % BLOCK).cast("int") + 1, (end - start).cast("int"))


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
