"""Quality by compression: a text is compressed with a dictionary of good and with one of bad labelled text.

The difference of the two sizes, per byte of text, is turned into a probability by a logistic curve that is fitted to
labelled texts the dictionaries have not seen. Texts are compressed in pieces, so that the dictionaries
matter as much at the end of a long text as at its start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import pure, rows, schema_with

PIECE, LEVEL, DICTIONARY_BYTES = 2048, 3, 48 << 10


@dataclass
class Model:
    """Dictionary bytes of bad and good text, and the curve: score = 1 / (1 + exp(-(slope * x + offset)))."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; of the raw bytes where there are too few samples to train one."""
    samples = [t[k:k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size] or b"\n" * 8


class Sizer:
    """Compressed sizes of the pieces of a text with two dictionaries."""

    def __init__(self, model: Model):
        self.compressors = []
        for data in (model.bad, model.good):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) per byte; 0 for an empty text."""
        if not text:
            return 0.0
        bad, good = (sum(len(c.compress(text[k:k + PIECE])) for k in range(0, len(text), PIECE)) for c in self.compressors)
        return (bad - good) / len(text)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve by damped Newton steps with a weak prior on the slope."""
    scale = max(float(x.std()), 1e-9) if len(x) else 1.0
    z, a, b = x / scale, 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (y - p)
        h = weight * p * (1 - p) + 1e-9
        gradient = np.array([(g * z).sum() - 1e-3 * a, g.sum() - 1e-3 * b])
        curve = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    return a / scale, b


def train(texts: list[bytes], labels: list[int], share_good: float) -> Model:
    """Dictionaries from every second text of a class, the curve from the others, weighted to `share_good`."""
    held = {k: [t for t, y in zip(texts, labels) if y == k] for k in (0, 1)}
    if not held[0] or not held[1]:
        chance = min(max(share_good, 0.01), 0.99)
        return Model(dictionary([]), dictionary([]), 0.0, math.log(chance / (1 - chance)))
    model = Model(dictionary(held[0][::2]), dictionary(held[1][::2]), 0.0, 0.0)
    rest = {k: held[k][1::2] or held[k] for k in (0, 1)}
    sizer = Sizer(model)
    x = np.array([sizer.difference(t) for k in (0, 1) for t in rest[k]])
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    share = np.where(y == 1, share_good / len(rest[1]), (1 - share_good) / len(rest[0]))
    slope, offset = calibrate(x, y, share * len(x))
    return Model(model.bad, model.good, float(slope), float(offset))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", max_per_class: int = 2000, max_chars: int = 20_000,
) -> Model:
    """A model from about `max_per_class` labelled texts of each class, of up to `max_chars`, chosen by hash.

    The chosen labels are at most a few thousand rows of two numbers and are broadcast. Labels other than 0
    and 1 are left out.
    """
    known = pure(labels, id=label_id_col, label=label_col).where("id is not null and label in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if not counts:
        return train([], [], 0.5)
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, max_per_class / n))) for k, n in counts.items()])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * max_per_class)
    texts = pure(docs, id=id_col, text=text_col).where(F.char_length("text").between(1, max_chars))
    found = sorted((r["text"].encode("utf-8", "surrogatepass"), int(r["label"]))
                   for r in texts.join(F.broadcast(picked), "id").select("text", "label").collect())
    return train([t for t, _ in found], [y for _, y in found], counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference, score) per row. A null text counts as empty; its difference is 0 and it has a score too.

    Whole texts are compressed. Repeated rows give repeated rows, other columns are ignored.
    """
    own = pure(docs, id=id_col, text=text_col)
    shared = own.sparkSession.sparkContext.broadcast(vars(model))  # plain data: broadcasts do not carry classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = Model(**shared.value)
        sizer = Sizer(own_model)
        for batch in batches:
            x = np.array([sizer.difference((t or "").encode("utf-8", "surrogatepass")) for _, t in rows(batch)], np.float64)
            p = 1 / (1 + np.exp(-np.clip(own_model.slope * x + own_model.offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x), pa.array(p)], ["id", "difference", "score"])

    return own.mapInArrow(run, schema_with(own, "difference double, score double")).withColumnRenamed("id", id_col)
