"""Personal data by weak supervision, with built-in functions only.

Candidate spans come from strict patterns (these stay in any case) and from looser ones. Labelers vote on each
candidate: a strict pattern, a gazetteer, the words before it, and its borders. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is. Its posteriors, as soft labels, train a naive Bayes
classifier on the shape of a span, which decides on the looser candidates. The driver sees counts per vote
pattern and per feature value, whose number does not depend on the data.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, let, pure
from runlens.llm.spans import apart, blocks, count_of, cut, find_spans, joined, ordered

# The strict patterns are written so that a failed attempt costs time in proportion to its own length
# and repetition needs no recursion: runs are entered at their start only.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = (f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\\.[A-Za-z0-9-][A-Za-z0-9.-]*?"
         "(?=\\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\\z)")
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12,18}(?![\\x20-]?[0-9])"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

LOOSE = {
    "email_like": f"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\\x20?(?:\\(at\\)|\\[at\\])\\x20?[A-Za-z0-9-]{{1,63}}"
                  "(?:\\x20?(?:\\.|\\(dot\\)|\\[dot\\])\\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "phone_like": "(?<![0-9A-Za-z+(.-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip_v6": "(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
KINDS = (*BASE, *LOOSE)

#: Words that announce a kind of data when they stand before it.
CONTEXT = {
    "email": "e-?mail|mailto|contact|courriel|correo|kontakt|write to", "phone": "phone|call|tel|mobile|fax|cell|handy",
    "card": "card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte", "ip": "\\bip\\b|address|host|server|client",
    "national_id": "ssn|social security|national id|passport", "iban": "iban|account|konto|compte|cuenta|bank",
}
_CUES = {"email_like": "email", "phone_like": "phone", "ip_v6": "ip"}

#: Gazetteers as patterns over a candidate: mail suffixes, calling codes, card issuers, routable blocks, countries.
GAZETTEER = {
    "email": "(?i)\\.(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|it|nl|us)$", "email_like": "(?i)(?:com|org|net|edu|de|fr|es|uk|io)$",
    "ip": "^(?!0|22[4-9]|2[3-5][0-9])[0-9]", "ip_v6": "^(?i:2|fd|fe80)", "phone": "^\\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5|6|8[1246]|9)",
    "phone_like": "^\\(?[2-9][0-9]{2}", "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "national_id": "^(?!000|666|9)", "iban": "^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
LABELERS = ("pattern", "gazetteer", "context", "borders")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(d: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            x = F.substr(d, F.char_length(d) - k, F.lit(1)).cast("int") * F.when(k % 2 == 1, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)
        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), step) % 10 == 0

    return let(digits, add)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def base_spans(text: Column) -> Column:
    """Matches of the strict patterns that pass their tests, by kind, then start."""
    n_digits = lambda s: F.char_length(_digits(s["text"]))
    return ordered(F.concat(
        find_spans(text, "email", EMAIL, hint=text.contains("@")),
        find_spans(text, "ip", IP, keep=lambda s: s["text"].rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), hint=text.rlike("[0-9]\\.[0-9]")),
        find_spans(text, "card", CARD, keep=lambda s: luhn(_digits(s["text"])), hint=text.rlike("[0-9][\\x20-]?[0-9]")),
        find_spans(text, "phone", PHONE, keep=lambda s: n_digits(s).between(9, 15), hint=text.rlike("\\+[0-9]")),
    ), BASE, by_start=False)


def loose_spans(text: Column) -> Column:
    numeric = text.rlike("[0-9]{2}")
    hints = {"email_like": text.rlike("[(\\[]at[)\\]]"), "ip_v6": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")}
    return F.concat(*[find_spans(text, k, p, hint=hints.get(k, numeric)) for k, p in LOOSE.items()])


def _described(pieces: Column, span: Column, strict: bool) -> Column:
    """A span with its votes (1 for, 0 against, -1 none) and the features of its shape; `pieces` are the text's blocks."""
    around = F.struct(
        cut(pieces, F.greatest(span["start"] - 40, F.lit(0)), span["start"]).alias("before"),
        cut(pieces, span["end"], span["end"] + 1).alias("following"))
    return let(around, lambda a: let(F.struct(
        span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), span["text"].alias("text"),
        a["before"].alias("before"), F.right(a["before"], F.lit(1)).alias("previous"), a["following"].alias("following"),
    ), lambda s: _voted(s, strict)))


def _voted(span: Column, strict: bool) -> Column:
    cues = {k: f"(?i)(?:{CONTEXT[_CUES.get(k, k)]})[^\\n]{{0,20}}$" for k in KINDS}
    before, previous, following = span["before"], span["previous"], span["following"]
    n_digits = F.char_length(_digits(span["text"]))
    known = F.coalesce(*[F.when(span["kind"] == k, span["text"].rlike(p)) for k, p in GAZETTEER.items()], F.lit(False))
    cue = F.coalesce(*[F.when(span["kind"] == k, before.rlike(p)) for k, p in cues.items()], F.lit(False))
    clear = (previous.rlike("^[\\s(\\[<:;,\"'=]?$")) & following.rlike("^[\\s)\\]>:;,.!?\"']?$")
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"), span["text"].alias("text"),
        F.array(
            F.lit(1 if strict else 0), known.cast("int"), F.when(cue, 1).otherwise(-1), clear.cast("int"),
        ).alias("votes"),
        F.array(
            F.concat(F.lit("digits="), F.least(n_digits, F.lit(20)).cast("string")),
            F.concat(F.lit("length="), F.least(F.floor(F.char_length(span["text"]) / 4), F.lit(12)).cast("string")),
            F.concat(F.lit("before="), F.when(previous == "", "start").when(previous.rlike("\\s"), "space").when(
                previous.rlike("\\p{L}"), "letter").when(previous.rlike("\\p{N}"), "digit").otherwise("other")),
            F.concat(F.lit("known="), known.cast("string")),
            F.concat(F.lit("cue="), cue.cast("string")),
            F.concat(F.lit("clear="), clear.cast("string")),
        ).alias("features"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, loose) per row: described spans of strict patterns, and of looser ones apart from them."""
    own = pure(docs, id=id_col, text=text_col)

    def both(t: Column) -> Column:
        def described(b: Column, loose: Column) -> Column:
            some = (F.size(b) > 0) | (F.size(loose) > 0)
            return let(F.when(some, blocks(t)), lambda p: F.struct(
                F.transform(b, lambda s: _described(p, s, True)).alias("base"),
                F.transform(loose, lambda s: _described(p, s, False)).alias("loose")))

        return let(base_spans(t), lambda b: let(apart(loose_spans(t), b, BASE), lambda loose: described(b, loose)))

    return own.select("id", let(F.coalesce("text", F.lit("")), both).alias("f")).select("id", "f.base", "f.loose")


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior per vote pattern by expectation-maximisation over conditionally independent labelers.

    Beta priors hold each labeler better than chance; -1 is no vote and says nothing.
    """
    prior, hit, miss = 0.5, [0.8] * len(LABELERS), [0.2] * len(LABELERS)
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for v, h, m in zip(p, hit, miss):
                odds += {1: math.log(h / m), 0: math.log((1 - h) / (1 - m)), -1: 0.0}[v]
            post[p] = 1 / (1 + math.exp(-odds))
        total = sum(patterns.values())
        prior = (1 + sum(n * post[p] for p, n in patterns.items())) / (2 + total)
        for k in range(len(LABELERS)):
            voted = [(p, n) for p, n in patterns.items() if p[k] >= 0]
            yes, no = sum(n * post[p] for p, n in voted), sum(n * (1 - post[p]) for p, n in voted)
            hit[k] = (8 + sum(n * post[p] for p, n in voted if p[k])) / (10 + yes)
            miss[k] = (2 + sum(n * (1 - post[p]) for p, n in voted if p[k])) / (10 + no)
    return post


def train(found: DataFrame) -> dict[str, float]:
    """Log-odds per feature value, and the prior under ''. Every candidate of the corpus counts."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.votes", "s.features")
    patterns = {tuple(r[0]): r[1] for r in spans.groupBy("votes").agg(F.count(F.lit(1))).collect()}
    post = estimate(patterns)
    if not post:
        return {"": 0.0}
    chance = F.coalesce(*[F.when(F.col("votes") == F.array(*map(F.lit, p)), F.lit(v)) for p, v in post.items()])
    soft = spans.withColumn("p", chance).select("p", F.explode("features").alias("feature"))
    sums = {r[0]: (r[1], r[2]) for r in soft.groupBy("feature").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()}
    yes = sum(n * post[p] for p, n in patterns.items())
    no = sum(n * (1 - post[p]) for p, n in patterns.items())
    odds = {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, (a, b) in sums.items()}
    return {"": math.log((yes + 1) / (no + 1)), **{f: round(v, 9) for f, v in odds.items()}}


def probability(features: Column, odds: dict[str, float]) -> Column:
    names = [f for f in odds if f]
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(odds[f]) for f in names])) if names else None
    weight = lambda f: F.coalesce(F.element_at(table, f), F.lit(0.0)) if names else F.lit(0.0)
    return 1 / (1 + F.exp(-F.aggregate(features, F.lit(odds[""]), lambda acc, f: acc + weight(f))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base, spans) per row: spans of the strict patterns, and these with looser ones of at least `least`.

    Spans are sorted by kind in the order of KINDS, then start. A null or empty text has no spans. Without any
    candidate in the table nothing is added. Repeated rows give repeated rows; other columns are ignored.
    """
    found = durable(candidates(docs, id_col, text_col))
    odds = train(found)
    added = F.filter("loose", lambda s: probability(s["features"], odds) >= least)
    return found.select(F.col("id").alias(id_col), "base", ordered(F.concat("base", added), KINDS, by_start=False).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.col("base")
    return found.select(
        id_col, *[count_of(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
