"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Both models are tables of character transitions. A long token is a secret when the log-likelihood ratio of the two
models, per transition, exceeds a threshold. Counting, fitting and scoring use built-in functions only; what
reaches the driver is one number per pair of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, let, pure, scan_prefix
from runlens.llm.spans import apart, blocks, count_of, cut, find_spans, joined, ordered

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, ACCESS_LENGTH = "AKIA[A-Z0-9]{14,}", 18
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of tokens; a transition is a pair of their places.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Tables of log-likelihoods per transition: of random strings, and of ordinary ones.
Model = tuple[list[list[float]], list[list[float]]]

#: Labelled strings that every model starts from, next to those of the corpus: (text, is random).
SEEDS = tuple((s, False) for s in (
    "get_user_name", "maximum_partition_bytes", "applicationController", "internationalization", "README_TEMPLATE",
    "connection-timeout-seconds", "HttpServletRequestWrapper", "characteristics", "test_resolves_relative_path",
    "responsibilities", "docker-compose-override", "Bundesverfassungsgericht", "anticonstitutionnellement",
    "MAXIMUM_BUFFER_SIZE", "DEFAULT_CONNECTION_TIMEOUT", "ENVIRONMENT_VARIABLE_NAMES", "INTERNAL_SERVER_ERROR_500",
    "backup_2019-12-05T18-30-00", "invoice-2021-06-30", "photo_2023-11-14_at_07-45", "release-notes-version-2-10-3",
    "src/main/resources/index2", "docs/chapter12/figure3", "column_14_of_table_6", "page=12/section=4", "utf8_general_ci",
)) + tuple((s, True) for s in (
    "q7Zk1Xv9Lw3Tb8Rn5Yd2", "9fK2mQ8xV4cJ7pT1sW6z", "Xr4Gt8Bn2Mk6Hv0Jq5Ls", "b3VtY2hQ7kX9wZ1rN5pD", "0aG7uE4yC8iO2lF6tS1j",
    "pzmqxk84hvw2jtd7c0rb", "Wq3hV/nE9+tKzB5yXg7o", "ZKQ8XW2JVH5TRNB3GPM6", "uJ2xQeLf6ZwvHm0KyRc8", "dGx5WnBqV3JtY1zCk9Sa",
))


def _hints(text: Column) -> tuple[Column, Column]:
    return text.rlike("(?i:password|passwd|secret|token|api_?key)"), text.contains("AKIA")


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns, by start, then kind."""
    assign, access = _hints(text)
    return ordered(F.concat(
        find_spans(text, "assign", ASSIGN, 2, lambda s: F.char_length(s["value"]) >= 12, assign),
        find_spans(text, "access", ACCESS, hint=access),
        find_spans(text, "hex", HEX),
    ), KINDS, by_start=True)


def _found(text: Column) -> Column:
    """A struct of the spans of the fixed patterns, and of long tokens apart from them."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(base_spans(t), lambda b: F.struct(
        b.alias("base"), apart(find_spans(t, "random", TOKEN), b, KINDS[:3]).alias("tokens"))))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, tokens) per row: spans of the fixed patterns, and long tokens apart from them."""
    own = pure(docs, id=id_col, text=text_col)
    return own.select("id", _found(F.col("text")).alias("f")).select("id", "f.base", "f.tokens")


def labelled_tokens(scan: DataFrame) -> DataFrame:
    """(text, is_random): what the fixed patterns found is random, long words of letters are ordinary."""
    secret = scan.select(F.explode("base").alias("s")).where("s.kind <> 'hex' or s.text rlike '[a-f]'").select(
        F.col("s.value").alias("text"), F.lit(True).alias("is_random"))
    plain = scan.select(F.explode("tokens").alias("s")).where("s.text rlike '^[A-Za-z][a-z]+$'").select(
        F.col("s.text").alias("text"), F.lit(False).alias("is_random"))
    return secret.unionAll(plain)


def _conditional(counts: dict[str, int], smoothing: float) -> dict[str, float]:
    """Chance of a pair's second character after its first, from pair counts.

    Rare first characters lean on the share of the second one among all pairs: a model without digits then finds
    digits unlikely everywhere, also after a character that it has never seen. That share leans on an even one.
    """
    mass = smoothing * len(ALPHABET)
    first = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    second = {b: sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
    total = sum(second.values())
    share = {b: (n + smoothing) / (total + mass) for b, n in second.items()}
    return {a + b: (counts.get(a + b, 0) + mass * share[b]) / (first[a] + mass) for a in ALPHABET for b in ALPHABET}


def fit(samples: DataFrame, smoothing: float = 0.5) -> Model:
    """Log-likelihoods per transition, learned from (text, is_random) rows; nulls are left out.

    All samples count. Random strings and ordinary ones have two models each, of `SEEDS` and of the samples, as
    either kind comes from several sources: a corpus whose known secrets are all hexadecimal does not make other
    random strings unlikely, and one of lower-case words does not make constants look random. A model has one
    number per pair of characters.
    """
    seeds = samples.sparkSession.createDataFrame(list(SEEDS), "text string, is_random boolean")
    every = samples.select("text", "is_random", F.lit(False).alias("is_seed")).dropna().unionAll(
        seeds.withColumn("is_seed", F.lit(True)))
    pairs = every.where(F.char_length("text") > 1).select("is_random", "is_seed", F.explode(F.transform(
        F.sequence(F.lit(1), F.char_length("text") - 1), lambda k: F.substr("text", k, F.lit(2)))).alias("pair"))
    counts: dict[tuple[bool, bool], dict[str, int]] = {}
    for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("is_random", "is_seed", "pair").agg(
            F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((r.is_random, r.is_seed), {})[r.pair] = r.n

    def models(is_random: bool) -> list[list[float]]:
        chances = [_conditional(counts[is_random, s], smoothing) for s in (True, False) if (is_random, s) in counts]
        return [[round(math.log(c[a + b]), 6) for a in ALPHABET for b in ALPHABET] for c in chances]

    return models(True), models(False)


def ratio(token: Column, model: Model) -> Column:
    """Mean log-likelihood ratio per transition of a token over the alphabet; either kind by its best model."""
    places = [ALPHABET.find(chr(c)) + 1 for c in range(128)]
    lookup = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")
    codes = F.transform(F.split(token, ""), lambda c: F.element_at(lookup, F.ascii(c) + 1) - 1)

    def mean(table: list[float], pairs: Column) -> Column:
        numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
        return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(numbers, i)) / F.size(pairs)

    def best(tables: list[list[float]], pairs: Column) -> Column:
        return F.array_max(F.array(*[mean(t, pairs) for t in tables]))

    pairs = let(codes, lambda k: F.transform(
        F.sequence(F.lit(0), F.size(k) - 2), lambda i: F.get(k, i) * len(ALPHABET) + F.get(k, i + 1) + 1))
    return let(pairs, lambda p: best(model[0], p) - best(model[1], p))


def random_tokens(tokens: Column, model: Model, least: float = 0.1, min_length: int = 20) -> Column:
    """Tokens that look random: long, with letters and digits, and a high enough ratio."""
    def test(s: Column) -> Column:
        mixed = s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")
        return (F.char_length(s["text"]) >= min_length) & mixed & (ratio(s["text"], model) > least)

    return F.filter(tokens, test)


def all_spans(base: Column, tokens: Column, model: Model, least: float = 0.1) -> Column:
    """The spans of `found` that count under a fitted model, sorted by start, then kind."""
    return ordered(F.concat(base, random_tokens(tokens, model, least)), KINDS, by_start=True)


def secret_spans(text: Column, model: Model, least: float = 0.1) -> Column:
    """All secrets of a text under a fitted model, sorted by start, then kind; null and empty texts have none."""
    return let(_found(text), lambda f: all_spans(f["base"], f["tokens"], model, least))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.1,
                labelled: DataFrame | None = None) -> DataFrame:
    """(id, base, spans) per row: secrets by fixed pattern, and these with random-looking tokens added.

    Spans carry start, end, kind, text and value and are sorted by start, then kind. The models are fitted to
    `labelled` (text, is_random), by default to what the fixed patterns and plain words of `docs` give. A null
    or empty text has no spans. Repeated rows give repeated rows; other columns are ignored.
    """
    scan = durable(found(docs, id_col, text_col))
    model = fit(labelled_tokens(scan) if labelled is None else labelled)
    return scan.select(
        F.col("id").alias(id_col), "base", all_spans(F.col("base"), F.col("tokens"), model, least).alias("spans"))


def digest(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.col("base")
    return scan.select(
        id_col, *[count_of(base, k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced by `mark`; overlapping spans become one. `spans` are sorted by start."""
    def clean(s: Column, pieces: Column, ends: Column) -> Column:
        def kept(reached: Column) -> Column:
            parts = F.transform(s, lambda x, k: F.when(
                x["start"] >= F.get(reached, k), F.concat(cut(pieces, F.get(reached, k), x["start"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(pieces, F.array_max(ends), F.char_length(text).cast("long")))

        return let(scan_prefix(ends, 0, add=F.greatest), kept)

    whole = let(spans, lambda s: let(blocks(text), lambda p: let(F.transform(s, lambda x: x["end"]), lambda e: clean(s, p, e))))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(whole)
