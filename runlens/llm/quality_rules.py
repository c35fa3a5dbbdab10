"""Quality rules: a threshold table compiled into one projection of ratios, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import let

#: What separates words: space and the ASCII controls from tab to carriage return.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "with",
    "au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que",
    "qui", "sur", "un", "une",
    "al", "con", "del", "el", "es", "las", "lo", "los", "no", "por", "se", "su", "una", "y",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
)

#: (rule, metric, least, most); a document breaks a rule outside the bounds. None: unbounded.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_length", "mean_word_length", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("exclamations", "exclamation_ratio", None, 0.2),
    ("letters", "alpha_word_ratio", 0.6, None),
    ("stop_words", "stop_word_ratio", 0.01, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
    ("bullets", "bullet_line_ratio", None, 0.9),
    ("ellipses", "ellipsis_line_ratio", None, 0.5),
)

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+")))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of `window` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Only a text with a repeated hash sorts its windows.
    """
    def covered(at: Column) -> Column:  # sorted window starts; each covers up to the next one
        widths = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def starts(hashes: Column) -> Column:
        marked = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        twice = let(marked, lambda s: F.filter(s, lambda x, k: (
            F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)))))
        return F.sort_array(F.transform(twice, lambda x: x["k"]))

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda k: F.xxhash64(F.slice(w, k, F.lit(window))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(starts(h), covered)))

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(count(w)))


def _counts(text: Column, stop_words: Sequence[str]) -> Column:
    """A struct of every count that the base columns and the rules need."""
    plain = text
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(BLANK)) != ""
    lines = F.filter(F.split(text, "\n", -1), has_word)

    def with_lists(w: Column, ls: Column) -> Column:
        total = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)
        some = lambda array, test: F.size(F.filter(array, test)).cast("long")
        lowered = lambda x: F.btrim(F.lower(x), F.lit(".,;:!?\"'()"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(plain)).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
            some(w, lambda x: x.rlike("\\p{L}")).alias("n_alpha_words"),
            some(w, lambda x: lowered(x).isin(*stop_words)).alias("n_stop_words"),
            some(ls, lambda x: x.rlike("^\\s*[-*\\u2022]")).alias("n_bullet_lines"),
            some(ls, lambda x: x.rlike("(\\.\\.\\.|\\u2026)\\s*$")).alias("n_ellipsis_lines"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: with_lists(w, ls)))


_RATIOS = {
    "mean_word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
    "exclamation_ratio": ("n_exclamations", "n_words"), "alpha_word_ratio": ("n_alpha_words", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def quality_rules(
    docs: DataFrame, text_col: str = "text", rules: Sequence[tuple] = RULES, stop_words: Sequence[str] = STOP_WORDS,
    name: str = "quality",
) -> DataFrame:
    """`docs` with one more column, a struct: counts, ratios, `base_failed`, `broken` (rule names) and `kept`.

    A null or blank text has no words, so it fails the base rule of at least 20 words. A ratio without a
    denominator is 0. Rows, ties and repeated rows are kept as they are. `name` replaces a column of that name.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def verdict(c: Column) -> Column:
        ratio = {m: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0)) for m, (a, b) in _RATIOS.items()}
        outside = []
        for rule, metric, least, most in rules:
            low = ratio[metric] < F.lit(float(least)) if least is not None else F.lit(False)
            high = ratio[metric] > F.lit(float(most)) if most is not None else F.lit(False)
            outside.append(F.when(low | high, F.lit(rule)))
        base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        broken = F.filter(F.array(*outside), lambda r: r.isNotNull())
        fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return let(broken, lambda b: F.struct(
            *[c[f].alias(f) for f in fields], *[v.alias(m) for m, v in ratio.items()],
            base.alias("base_failed"), b.alias("broken"), (~base & (F.size(b) == 0)).alias("kept")))

    counted = let(F.struct(text.alias("text")), lambda s: _counts(s["text"], stop_words))
    return docs.withColumn(name, let(counted, verdict))
