"""URL filters: explicit rules first, else gradient-boosted trees on lexical features of the URL.

Features and verdicts are built-in functions, the trees are Spark's own. The labelled URLs for training are, by
default, those that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, let

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens", "suffix_rate", "site_rate")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's; else null."""
    tests = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def entropy(text: Column) -> Column:
    """Bits per character."""
    def bits(t: Column) -> Column:
        share = lambda c: (F.char_length(t) - F.char_length(F.replace(t, c, F.lit("")))) / F.char_length(t)
        return F.aggregate(
            F.array_distinct(F.split(t, "")), F.lit(0.0), lambda acc, c: acc + let(share(c), lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    return let(text, lambda t: F.when(t == "", 0.0).otherwise(bits(t)))


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    counted = lambda c, what: (F.char_length(c) - F.char_length(F.regexp_replace(c, what, ""))).cast("double")
    length = F.char_length(url).cast("double")
    return {
        "length": length, "host_length": F.char_length(host).cast("double"), "depth": counted(path, "/"),
        "digit_ratio": F.when(length > 0, counted(url, "[0-9]") / length).otherwise(0.0), "entropy": entropy(url),
        "n_params": F.when(url.contains("?"), counted(F.regexp_extract(url, "(?s)\\?([^#]*)", 1), "&") + 1).otherwise(0.0),
        "n_labels": F.when(host == "", 0.0).otherwise(counted(host, "\\.") + 1), "n_hyphens": counted(host, "-"),
    }


def _with_rates(df: DataFrame, labelled: DataFrame, others_only: bool = False) -> DataFrame:
    """Adds the smoothed share of blocked URLs under the host's last label and its last two labels.

    With `others_only`, `df` are the labelled rows themselves and a row's rates come from the other folds alone. Hosts are dealt
    to folds whole, so that a rate says no more of a training row than of a host that was never seen.
    """
    base = float(labelled.agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("share")).first()["share"])
    for key, rate in (("suffix", "suffix_rate"), ("site", "site_rate")):
        counts = labelled.groupBy(key, "fold").agg(F.sum("label").alias("blocked"), F.count("label").alias("n"))
        total, on = counts.groupBy(key).agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")), [key]
        if others_only:
            own, on = counts.select(key, "fold", F.col("blocked").alias("own_blocked"), F.col("n").alias("own_n")), [key, "fold"]
            total = own.join(total, key).select(
                *on, (F.col("blocked") - F.col("own_blocked")).alias("blocked"), (F.col("n") - F.col("own_n")).alias("n"))
        rates = total.select(*on, ((F.col("blocked") + 5 * base) / (F.col("n") + 5)).alias(rate))
        df = df.join(rates, on, "left").withColumn(rate, F.coalesce(rate, F.lit(base)))
    return df


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
    labels: DataFrame | None = None, max_labelled: int = 20_000, trees: int = 10, depth: int = 4, least: float = 0.5,
    folds: int = 5,
) -> DataFrame:
    """(id, host, path, rule, score, verdict) per row: `allow` or `block`, by the longest rule or by the trees.

    `labels` (url, blocked) are the labelled URLs; null stands for the URLs of `pages` that a rule decides.
    The trees are fitted to about `max_labelled` of them, chosen by hash, at most twice as many; the rates they learn from
    leave out a host's own one of `folds` folds. `score` is the chance of
    being blocked. With labels of one kind only, that kind is the verdict; without any, `allow`. A null URL, or
    one without `://`, has an empty host and path and is scored like others. Repeated rows are kept.
    """
    def parsed(df: DataFrame, url: str, *keep: Column) -> DataFrame:
        text = F.coalesce(F.col(url), F.lit(""))
        split = df.select(*keep, text.alias("url"), host_of(text).alias("host"), path_of(text).alias("path"))
        lexical = [c.alias(n) for n, c in _lexical(F.col("url"), F.col("host"), F.col("path")).items()]
        return split.select(
            "*", *lexical, F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("site"))

    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    own = parsed(pages, url_col, F.col(id_col).alias("id")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.element_at(verdicts, F.col("rule"))
    if labels is None:
        known = own.where("rule is not null").withColumn("label", (ruled == "block").cast("double"))
    else:
        known = parsed(labels.dropna(), "url", F.col("blocked").cast("double").alias("label")).where("label in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(counts) < 2:
        scored = own.withColumn("score", F.lit(float(next(iter(counts), 0.0))))
    else:
        share = min(1.0, max_labelled / sum(counts.values()))
        chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 40)) < int(share * (1 << 40))
        sample = durable(known.where(chosen).limit(2 * max_labelled))
        if sample.select("label").distinct().count() < 2:  # one kind is very rare: as many of each
            both = [known.where(F.col("label") == kind).limit(max_labelled // 2) for kind in counts]
            sample = durable(both[0].unionAll(both[1]))
        sample = sample.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(folds)))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(
            assembler.transform(_with_rates(sample, sample, others_only=True)).select("features", "label"))
        ready = assembler.transform(_with_rates(own, sample))
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(ruled, F.when(F.col("score") > least, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", "score", verdict.alias("verdict"))
