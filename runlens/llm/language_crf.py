"""Language of every word by a linear-chain conditional random field, and of a text by the mean of its words.

Words are the positions of the chain. Their features are hashed character n-grams with word borders (so also affixes)
and the word itself as a lexicon entry. Transitions between languages are learned on code-switched sequences, made
by joining stretches of labelled texts. Marginals come from the forward-backward algorithm, which runs over
all texts of a batch at once: transfer matrices of fixed-size blocks, then messages inside the blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import pure, rows, schema_with

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"

#: Hash buckets of features, longest n-gram, positions per block.
BUCKETS, LONGEST, BLOCK = 1 << 17, 4, 256

#: Words that are decoded at a time; a longer text is decoded alone.
BATCH_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case; none if there is no letter at all."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(any(map(str.isalpha, w)) for w in words) else []


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of arrays (word, bucket): one pair per n-gram length, and one for whole words."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:]
        inside = word[:len(h)] == word[n - 1:]
        mixed = (h[inside] ^ np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((word[:len(h)][inside], (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    salt = np.uint64(0xBF58476D1CE4E5B9) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    own = (codes + np.uint64(7)) * salt
    own = np.add.reduceat(own ^ (own >> np.uint64(29)), np.cumsum(lengths) - lengths) * np.uint64(0x94D049BB133111EB)
    out.append((np.arange(len(words)), (own >> np.uint64(40)).astype(np.int64) % BUCKETS))
    return out


@dataclass
class Crf:
    """Labels, feature weights (BUCKETS x labels), transition scores, start scores."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        out = np.zeros((n, len(self.labels)))
        for word, bucket in found:
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(word, self.weights[bucket, k], n)
        return out

    def marginals(self, scores: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities per position, and expected transitions, of sequences laid end to end.

        Each position has a transfer matrix; at the start of a sequence all its rows are the start scores, which
        cuts the chain. Blocks of positions run in parallel, their products link them.
        """
        n, size = scores.shape
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        blocks = -(-n // BLOCK)
        pad = blocks * BLOCK - n
        emit = np.concatenate([emit, np.ones((pad, size))]).reshape(blocks, BLOCK, size)
        cut = np.concatenate([begins, np.ones(pad, bool)]).reshape(blocks, BLOCK)
        inner, first = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())

        def moved(messages: np.ndarray, t: int) -> np.ndarray:  # (..., labels) through position t of every block
            total = messages.sum(axis=-1, keepdims=True)
            at = cut[:, t].reshape(-1, *[1] * (messages.ndim - 1))
            e = emit[:, t].reshape(blocks, *[1] * (messages.ndim - 2), size)
            out = np.where(at, total * first, messages @ inner) * e
            return out / np.maximum(out.sum(axis=tuple(range(1, out.ndim)), keepdims=True), 1e-300)

        product = np.broadcast_to(np.eye(size), (blocks, size, size)).copy()
        for t in range(BLOCK):
            product = moved(product, t)
        into = np.empty((blocks, size))
        message = np.full(size, 1 / size)
        for b in range(blocks):
            into[b] = message
            message = message @ product[b]
            message = message / message.sum()
        back = np.empty((blocks, size))
        message = np.ones(size)
        for b in reversed(range(blocks)):
            back[b] = message
            message = product[b] @ message
            message = message / message.max()
        alpha, beta = np.empty_like(emit), np.empty_like(emit)
        now = into
        for t in range(BLOCK):
            now = moved(now, t)
            alpha[:, t] = now
        now = back
        for t in reversed(range(BLOCK)):
            beta[:, t] = now
            sent = emit[:, t] * now
            now = np.where(cut[:, t:t + 1], (sent * first).sum(axis=1, keepdims=True), sent @ inner.T)
            now = now / np.maximum(now.max(axis=1, keepdims=True), 1e-300)
        alpha, beta, emit = (x.reshape(-1, size)[:n] for x in (alpha, beta, emit))
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = np.zeros((size, size))
        inside = np.flatnonzero(~begins[1:]) + 1
        if len(inside):
            joint = alpha[inside - 1][:, :, None] * inner * (emit[inside] * beta[inside])[:, None, :]
            pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return gamma, pairs


def train(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 12_000, rate: float = 0.3, seed: int = 7) -> Crf:
    """Maximum likelihood by AdaGrad on sequences of stretches from texts of changing languages."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    size = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size))
    stretches = []
    for text, lang in zip(texts, langs):
        words, at = words_of(text), 0
        while at < len(words):
            step = int(rng.integers(15, 90))
            stretches.append((words[at:at + step], labels.index(lang)))
            at += step
    seen = [np.full_like(x, 1e-3) for x in (model.weights, model.transitions, model.start)]
    for _ in range(epochs if size > 1 else 0):
        order, at = rng.permutation(len(stretches)), 0
        while at < len(order):
            words: list[str] = []
            gold, begins = [], []
            while at < len(order) and len(words) < batch:
                own, label = stretches[order[at]]
                begins += [not words or rng.random() < 0.4, *[False] * (len(own) - 1)]
                words += own
                gold += [label] * len(own)
                at += 1
            vocabulary: dict[str, int] = {}
            index = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])
            found = features(list(vocabulary))
            starts, y, n = np.array(begins), np.array(gold), len(words)
            gamma, pairs = model.marginals(model.emissions(found, len(vocabulary))[index], starts)
            wrong = -gamma
            wrong[np.arange(n), y] += 1
            inside = np.flatnonzero(~starts[1:]) + 1
            np.add.at(observed := np.zeros((size, size)), (y[inside - 1], y[inside]), 1)
            per_word = np.stack([np.bincount(index, wrong[:, k], len(vocabulary)) for k in range(size)], axis=1)
            slope = np.zeros_like(model.weights)
            for word, bucket in found:
                for k in range(size):
                    slope[:, k] += np.bincount(bucket, per_word[word, k], BUCKETS)
            slopes = [slope / n * 100, (observed - pairs) / n * 100, wrong[starts].sum(axis=0) / n * 100]
            for value, step, past in zip((model.weights, model.transitions, model.start), slopes, seen):
                past += step * step
                value += rate * step / np.sqrt(past)
    return Crf(labels, model.weights.astype(np.float32), model.transitions, model.start)


def predict(model: Crf, texts: list[list[str]]) -> list[tuple[str, float]]:
    """(language, score) of texts given as words; the score is the mean probability over the words."""
    if not model.labels:
        return [(UNKNOWN, 0.0)] * len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    vocabulary: dict[str, int] = {}
    index = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t), np.int64, lengths.sum())
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    first = np.cumsum(lengths[full]) - lengths[full]
    begins = np.zeros(len(index), bool)
    begins[first] = True
    gamma, _ = model.marginals(model.emissions(features(list(vocabulary)), len(vocabulary))[index], begins)
    means = np.add.reduceat(gamma, first, axis=0) / lengths[full][:, None]
    for k, mean in zip(full.tolist(), means):
        best = int(mean.argmax())
        out[k] = (model.labels[best], min(1.0, float(mean[best])))
    return out


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a row without id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def sample(docs: DataFrame, text_col: str, lang_col: str, max_docs: int, max_chars: int) -> list[tuple[str, str]]:
    """At most about `max_docs` labelled rows of texts up to `max_chars`, chosen by hash."""
    known = pure(docs, text=text_col, lang=lang_col).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.char_length("text").between(1, max_chars))
    total = known.select("lang").count()
    share = min(1.0, max_docs / max(1, total))
    picked = known.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return sorted((r["text"], r["lang"]) for r in picked.limit(2 * max_docs).collect())


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 1200, max_chars: int = 8000) -> Crf:
    """A model from at most about `max_docs` labelled rows; without any label it predicts nothing."""
    found = sample(docs, text_col, lang_col, max_docs, max_chars)
    return train([t for t, _ in found], [lang for _, lang in found])


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row; `und` with score 0 for a text that is null or has no letter.

    Whole texts are decoded. Ties go to the first language by name. Repeated rows give repeated rows, other
    columns are ignored.
    """
    own = pure(docs, id=id_col, text=text_col)
    shared = own.sparkSession.sparkContext.broadcast(vars(model))  # plain data: broadcasts do not carry classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(**shared.value)
        for batch in batches:
            found, held, size = [], [], 0
            for _, text in rows(batch):
                words = words_of(text)
                if size + len(words) > BATCH_WORDS:
                    found += predict(crf, held)
                    held, size = [], 0
                held.append(words)
                size += len(words)
            found += predict(crf, held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["id", "lang_pred", "score"])

    return own.mapInArrow(run, schema_with(own, "lang_pred string, score double")).withColumnRenamed("id", id_col)
