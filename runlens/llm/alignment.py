"""Alignment of two tokenizers' ids of the same texts, and how many documents link each pair of ids.

Both id lists of a text get dictionaries from the byte at which a token ends to the token's index. The ends that both
dictionaries hold, sorted, cut the lists into groups of equal bytes. Inside a group every token of the
one list is linked with every token of the other.

The links of a document are kept as its different id pairs with their numbers. Documents per pair are counted with
map-side combine. For the way back, pairs that many documents hold are looked up in a broadcast table, whose number of
rows is counted and bounded before; the others meet their counts in a join by pair, in which no pair
has more rows than the bound left over, so common words make no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable_table, pure, rows, schema_with
from runlens.llm.packing import Encoder

#: A pair of ids as one number: the first id above so many bits, the second below. Ids have fewer bits than the second number.
BITS, IDS = 20, 17

#: Pairs that are looked up by broadcast at most; a row is 17 bytes.
COMMON = 200_000

#: Links of a group that are written out before they are counted; larger groups are counted by ids first.
EXPANDED = 1 << 14


class PieceEncoder:
    """Ids of a sentencepiece model, and the bytes that each id stands for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.token_bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Vocabulary:
    """The bytes of all ids end to end."""

    def __init__(self, token_bytes: list[bytes]):
        self.lengths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def joined(self, ids: np.ndarray) -> bytes:
        sizes, ends = self.lengths[ids], self.ends(ids)
        return self.bytes[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes()


def tokens(
    text: str | None, first: Encoder, second: PieceEncoder, a_known: Vocabulary, b_known: Vocabulary,
) -> tuple[np.ndarray, np.ndarray]:
    """Both id lists; none if the text is empty or the bytes of either list are not those of space and text."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    a, b = first.array(" " + text), np.array(second.ids(text), np.int64)
    whole = b" " + text.encode()
    return (a, b) if a_known.joined(a) == whole == b_known.joined(b) else (none, none)


def cuts(a: np.ndarray, b: np.ndarray, a_known: Vocabulary, b_known: Vocabulary) -> tuple[list[int], list[int]]:
    """Where the groups end, as token counts of either list."""
    a_ends = dict(zip(a_known.ends(a).tolist(), range(1, len(a) + 1)))
    b_ends = dict(zip(b_known.ends(b).tolist(), range(1, len(b) + 1)))
    common = [*filter(b_ends.__contains__, a_ends)]  # ends only grow, and so do a dictionary's keys
    return [*map(a_ends.__getitem__, common)], [*map(b_ends.__getitem__, common)]


@cache
def _names() -> np.ndarray:
    """Every id as bytes, followed by each of the marks: by mark, then id. Shorter ones are filled up with zeros."""
    return np.array([b"%d%c" % (i, mark) for mark in b",|;" for i in range(1 << IDS)], "S8").view(np.uint64)


def digest(a: np.ndarray, b: np.ndarray, a_cuts: list[int], b_cuts: list[int]) -> str:
    """SHA-256 of the groups as text, in order."""
    if not len(a):
        return ""
    names = _names()
    a_ends, b_ends = np.array(a_cuts), np.array(b_cuts)
    of_a, of_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
    out = np.empty(len(a) + len(b), names.dtype)
    for ids, ends, sizes, before, mark in ((a, a_ends, of_a, b_ends - of_b, 1), (b, b_ends, of_b, a_ends, 2)):
        marked = ids.copy()
        marked[ends - 1] += mark << IDS
        out[np.arange(len(ids)) + np.repeat(before, sizes)] = names[marked]
    return hashlib.sha256(out.tobytes().translate(None, b"\0")[:-1]).hexdigest()


def links(a: np.ndarray, b: np.ndarray, a_cuts: list[int], b_cuts: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """The different pairs, how many links each has, and the number of all links."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    ends_a, ends_b = np.array(a_cuts, np.int64), np.array(b_cuts, np.int64)
    m, n = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    pairs, counts = [], []
    large = m * n > EXPANDED
    for g in np.flatnonzero(large):
        x, of_x = np.unique(a[ends_a[g] - m[g]:ends_a[g]], return_counts=True)
        y, of_y = np.unique(b[ends_b[g] - n[g]:ends_b[g]], return_counts=True)
        pairs.append(((x[:, None] << BITS) | y[None, :]).ravel())
        counts.append((of_x[:, None] * of_y[None, :]).ravel())
    starts_a, starts_b = ends_a - m, ends_b - n
    if pairs:
        m, n, starts_a, starts_b = m[~large], n[~large], starts_a[~large], starts_b[~large]
    size = m * n
    group = np.repeat(np.arange(len(m)), size)
    at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)  # place within the group's links
    row, column = np.divmod(at, n[group])
    expanded = (a[starts_a[group] + row] << BITS) | b[starts_b[group] + column]
    if not pairs:
        pair, count = np.unique(expanded, return_counts=True)
        return pair, count, len(expanded)
    pair, place = np.unique(np.concatenate([*pairs, expanded]), return_inverse=True)
    count = np.bincount(place, np.concatenate([*counts, np.ones(len(expanded), np.int64)]), len(pair)).astype(np.int64)
    return pair, count, int(count.sum())


def align(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) per row of `docs`; `row` is unique.

    `pairs` holds each different pair of linked ids once, `counts` its links in the text.
    """
    own = pure(docs, id=id_col, text=text_col)
    names = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Encoder(first_path, specials=False), PieceEncoder(second_path)
        if max(len(first.token_bytes), len(second.token_bytes)) > 1 << IDS:
            raise ValueError("vocabularies of more ids than IDS allows")
        a_known, b_known = Vocabulary(first.token_bytes), Vocabulary(second.token_bytes)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, pairs, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, text in rows(batch):
                a, b = tokens(text, first, second, a_known, b_known)
                a_cuts, b_cuts = cuts(a, b, a_known, b_known)
                pair, count, n = links(a, b, a_cuts, b_cuts)
                out.append((row, len(a), len(b), len(a_cuts), n, digest(a, b, a_cuts, b_cuts)))
                pairs.append(pair)
                counts.append(count)
                row += 1
            ends = pa.array(np.cumsum([len(p) for p in pairs]), pa.int32())
            plain = [pa.array(list(c), pa.string() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out))] if out else [
                pa.array([], pa.string() if k == 5 else pa.int64()) for k in range(6)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *plain, *lists], ["id", *names])

    return own.mapInArrow(run, schema_with(
        own, "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked, and whether no other pair of its first id is held by more."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    n = durable_table(n)
    a = F.shiftright("pair", BITS)
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(counted: DataFrame, limit: int) -> int:
    """The smallest power of two that is the least count of at most `limit` pairs. Collects a row per power."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(counted.groupBy(power.alias("power")).agg(F.count(F.lit(1))).collect())
    room = limit
    for k in sorted(sizes, reverse=True):
        room -= sizes[k]
        if room < 0:
            return 1 << (k + 1)
    return 1


def cross_tokenizer_alignment(
    docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of `docs`.

    A pair's count is the number of rows that hold it linked; `n_best` are the links whose pair has the highest count
    of its first id, ties included, `count_sum` the sum of the counts over all links. A null or empty text, or one whose
    tokens do not give its bytes again, has zeros and an empty digest. Repeated rows and ids count as
    documents of their own. Other columns are ignored. An empty table gives an empty one.
    """
    aligned = durable_table(align(docs, first_path, second_path, id_col, text_col))
    counted = durable_table(pair_counts(aligned))
    least = common_from(counted, common)
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("links"))

    def totals(found: DataFrame) -> DataFrame:
        return found.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n")).alias("count_sum"))

    often = counted.where(F.col("n") >= least)
    found = totals(held.join(F.broadcast(often), "pair"))
    if least > 1:
        rest = held.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        found = found.unionAll(totals(rest.join(counted.where(F.col("n") < least), "pair")))
        found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs", "counts").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *whole, "groups_sha256")
