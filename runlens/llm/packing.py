"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Only documents longer than a sequence are cut. The pieces are placed from long to short. A round takes the pieces of
one band of lengths, range-sorts them together with the gaps of the open sequences by size, and sweeps from large
to small: a piece takes the smallest gap that holds it and is still free. Every partition sweeps its own range;
what is left over in the partitions is matched between them by rank, with a table of two counts per
partition. Pieces without a gap open new sequences, the gaps are updated, and the next band follows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import durable, fitted, pure, rows, schema_with, tasks_for

CAPACITY, END = 1024, 2

#: How byte-level vocabularies split text before merging, and how they write bytes as characters.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library, which gives the same ids.

    The merges run in tiktoken, about five times as fast. Its pattern engine gives up on very long runs of white
    space; such a text goes to the tokenizers library. Without `specials` their strings are plain text.
    """

    def __init__(self, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        byte = _byte_of_character()
        ranks = {bytes(byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.path, self.plain, self.specials = path, None, specials
        self.size = max([*ranks.values(), *special.values()]) + 1
        token_of = {i: token for token, i in ranks.items()}
        self.token_bytes = [token_of.get(i, b"") for i in range(self.size)]
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        return self._or_slow(text, lambda: self.fast.encode(text, allowed_special="all") if self.specials else self.fast.encode_ordinary(text))

    def array(self, text: str) -> np.ndarray:
        """The same ids without a list in between."""
        known = "all" if self.specials else set()
        return np.asarray(self._or_slow(text, lambda: self.fast.encode_to_numpy(text, allowed_special=known, disallowed_special=())), np.int64)

    def _or_slow(self, text: str, fast: Callable[[], Sequence[int]]) -> Sequence[int]:
        try:
            return fast()
        except BaseException as problem:
            if type(problem).__name__ != "PanicException":  # the pattern engine's, which is no Exception
                raise
            return self.slow_ids(text)

    def slow_ids(self, text: str) -> list[int]:
        if self.plain is None:
            from tokenizers import Tokenizer
            self.plain = Tokenizer.from_file(self.path)
            self.plain.encode_special_tokens = not self.specials
        return self.plain.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end: int = END, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the documents' tokens with an end token, cut where needed."""
    own = pure(docs, id=id_col, text=text_col)
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            which, out, lists = [], [], []
            for k, (_, text) in enumerate(rows(batch)):
                ids = np.array([*encoder.ids(text or ""), end], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start:start + length]
                    which.append(k)
                    out.append((piece, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        lists.append(part.astype(np.int32))
            columns = list(zip(*out)) or [()] * 4
            arrays = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(columns[0], pa.int32()),
                      *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return own.mapInArrow(run, schema_with(own, fields))


def bands(capacity: int) -> list[tuple[int, int]]:
    """(shortest - 1, longest) of the rounds, from long to short."""
    tops, k = [], 1
    while k < capacity:
        tops.append(capacity // k)
        k = max(k + 1, k * 3 // 2)
    return [(low, high) for high, low in zip(tops, [*tops[1:], 0]) if high > low]


_SWEPT = "piece boolean, pid long, sequence long, size long, run int, place long, copies long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match the pieces of a sorted range with its gaps; what stays unmatched gets a place in this range's order.

    A gap comes with a number of equal copies; those left over are one row, whose place is that of the first.
    """
    free: list[list[int]] = []
    run, unplaced, place = TaskContext.get().partitionId(), 0, 0
    schema = pa.schema([("piece", pa.bool_()), ("pid", pa.int64()), ("sequence", pa.int64()), ("size", pa.int64()),
                        ("run", pa.int32()), ("place", pa.int64()), ("copies", pa.int64())])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in batches:
        out = []
        for is_piece, key, size, copies in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not is_piece:
                free.append([key, size, copies])
            elif free:
                out.append((True, key, free[-1][0], size, run, None, None))
                free[-1][2] -= 1
                if not free[-1][2]:
                    free.pop()
            else:
                out.append((True, key, None, size, run, unplaced, None))
                unplaced += 1
        if out:
            yield packed(out)
    out = []
    for key, size, copies in free:
        out.append((False, None, key, size, run, place, copies))
        place += copies
    if out:
        yield packed(out)


def _matches(counts: dict[int, tuple[int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Rank ranges of pieces and gaps that partitions match between them, and those of pieces that find none.

    `counts`: (pieces, gaps) left over per partition; all gaps of a partition are smaller than those of
    earlier ones and at least as large as the pieces of later ones, so the latest free gap is the tightest.
    """
    free: list[list[int]] = []  # partition, number of gaps
    joined, opened, before = [], [], 0
    for run in sorted(counts):
        left, n_gaps = counts[run]
        at = 0
        while at < left and free:
            other, n = free[-1]
            take = min(n, left - at)
            joined.append((run, at, at + take, other, n - 1))  # piece `at + j` takes gap `n - 1 - j`
            at += take
            free[-1][1] -= take
            if not free[-1][1]:
                free.pop()
        if at < left:
            opened.append((run, at, left, before - at))  # rank among the pieces that open: place + before - at
            before += left - at
        if n_gaps:
            free.append([run, n_gaps])
    return joined, opened


def _openings(counts: dict[int, int], capacity: int, next_sequence: int) -> tuple[list[tuple], int]:
    """How pieces in order of falling size fill new sequences, each with as many as its first one allows.

    `counts`: pieces per size. Per size: rank of its first piece, how many complete the sequence before and that
    sequence, the first sequence of the others, how many it takes.
    """
    out, rank, open_sequence, room = [], 0, -1, 0
    for size in sorted(counts, reverse=True):
        n, k = counts[size], capacity // size
        joining = min(n, room)
        others = n - joining
        out.append((size, rank, joining, open_sequence, next_sequence, k))
        room -= joining
        if others:
            used = -(-others // k)
            open_sequence, room = next_sequence + used - 1, used * k - others
            next_sequence += used
        rank += n
    return out, next_sequence


def _round(
    band: DataFrame, gaps: DataFrame, low: int, high: int, capacity: int, next_sequence: int, n: int,
) -> tuple[DataFrame, int]:
    """(pid, sequence, size) of all pieces of the band, and the next free sequence number. `n`: pieces and sequences at most."""
    spark = band.sparkSession
    slots = F.greatest(F.floor(F.col("gap") / high), F.lit(1))
    first = F.struct((F.col("gap") - (slots - 1) * high).cast("long").alias("size"), F.lit(1).cast("long").alias("copies"))
    rest = F.struct(F.lit(high).cast("long").alias("size"), (slots - 1).cast("long").alias("copies"))
    spread = gaps.where(F.col("gap") > low).select("sequence", F.inline(F.array(first, rest))).where("copies > 0")
    both = band.select(F.lit(True).alias("piece"), F.col("pid").alias("key"), F.col("length").alias("size"), F.lit(1).cast("long").alias("copies")).unionAll(
        spread.select(F.lit(False).alias("piece"), F.col("sequence").alias("key"), "size", "copies"))
    order = [F.desc("size"), F.asc("piece"), F.asc("key")]
    ranged = both.repartitionByRange(tasks_for(2 * n), *order).sortWithinPartitions(*order)
    swept = fitted(durable(ranged.mapInArrow(_sweep, _SWEPT)), n)
    left = swept.where("place is not null").groupBy("run").agg(
        F.count_if("piece").alias("pieces"), F.sum(F.when(F.col("piece"), 0).otherwise(F.col("copies"))).alias("gaps"))
    joined, opened = _matches({r["run"]: (r["pieces"], r["gaps"]) for r in fitted(left, n).collect()})
    placed = swept.where("piece and sequence is not null").select("pid", "sequence", "size")
    waiting = swept.where("piece and sequence is null").select("pid", "size", "run", "place")
    if joined:  # at most two entries per partition
        table = spark.createDataFrame(joined, "run int, low long, high long, other int, last long")
        target = waiting.join(F.broadcast(table), "run").where("place >= low and place < high").select(
            "pid", "size", F.col("other").alias("run"), (F.col("last") - (F.col("place") - F.col("low"))).alias("place"))
        taken: dict[int, int] = {}
        for _, start, stop, other, last in joined:  # of a partition's gaps the last ones are taken
            taken[other] = min(taken.get(other, last), last - (stop - start) + 1)
        lows = spark.createDataFrame([*taken.items()], "run int, lowest long")
        end = F.col("place") + F.col("copies") - 1
        free = swept.where("not piece").join(F.broadcast(lows), "run").where(end >= F.col("lowest")).select(
            "sequence", "run", F.explode(F.sequence(F.greatest("place", "lowest"), end)).alias("place"))
        placed = placed.unionAll(target.join(free, ["run", "place"]).select("pid", "sequence", "size"))
    if opened:
        table = spark.createDataFrame(opened, "run int, low long, high long, shift long")
        alone = waiting.join(F.broadcast(table), "run").where("place >= low and place < high").select(
            "pid", "size", (F.col("place") + F.col("shift")).alias("rank"))
        sizes = dict(fitted(alone.groupBy("size").agg(F.count(F.lit(1))), n).collect())
        plan, next_sequence = _openings(sizes, capacity, next_sequence)  # an entry per size
        fill = spark.createDataFrame(plan, "size long, first long, joining long, before long, base long, k long")
        at = F.col("rank") - F.col("first")
        sequence = F.when(at < F.col("joining"), F.col("before")).otherwise(
            F.col("base") + F.floor((at - F.col("joining")) / F.col("k")))
        placed = placed.unionAll(alone.join(F.broadcast(fill), "size").select("pid", sequence.cast("long").alias("sequence"), "size"))
    return durable(fitted(placed, n)), next_sequence


def assign(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pid, sequence, size): a sequence from 0 on for every (pid, length) row of length 1 to `capacity`."""
    spark = sizes.sparkSession
    limits = bands(capacity)
    names = F.coalesce(*[F.when(F.col("length") > low, F.lit(b)) for b, (low, _) in enumerate(limits)])
    counts = dict(sizes.groupBy(names.alias("b")).agg(F.count(F.lit(1))).collect())
    sizes = durable(fitted(sizes, sum(counts.values())))
    every = spark.createDataFrame([], "pid long, sequence long, size long")
    gaps, next_sequence = spark.createDataFrame([], "sequence long, gap long"), 0
    for b, (low, high) in enumerate(limits):
        if not counts.get(b):
            continue
        known = next_sequence
        band = sizes.where((F.col("length") > low) & (F.col("length") <= high))
        placed, next_sequence = _round(band, gaps, low, high, capacity, known, counts[b] + known)
        whole = F.when(F.col("sequence") >= known, F.lit(capacity)).otherwise(F.lit(0))
        taken = placed.select("sequence", (-F.col("size")).alias("gap"))
        open_gaps = gaps.unionAll(taken).groupBy("sequence").agg((F.sum("gap") + F.first(whole)).cast("long").alias("gap"))
        gaps = durable(fitted(open_gaps.where("gap > 0"), next_sequence))
        every = every.unionAll(placed)
    return every


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end: int = END, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) per piece of every document.

    A null or empty text is one piece that holds the end token. A document of more than `capacity` tokens is cut
    into pieces of that many, the first of which may be shorter. No sequence exceeds `capacity`; its pieces lie
    side by side from 0, the longest first. Repeated rows and ids are packed like other documents. Other columns
    are ignored. An empty table gives an empty one.
    """
    numbered = durable(pieces(docs, tokenizer_path, id_col, text_col, capacity, end, with_ids).withColumn(
        "pid", F.monotonically_increasing_id()))
    whole = F.col("length") == capacity
    placed = assign(numbered.where(~whole).select("pid", "length"), capacity)
    in_order = Window.partitionBy("sequence").orderBy(F.desc("size"), "pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("pid", F.col("sequence").alias("sequence_id"), F.coalesce(F.sum("size").over(in_order), F.lit(0)).alias("offset"))
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    shared = numbered.where(~whole).join(offsets, "pid").select(*columns)
    alone = numbered.where(whole).withColumns(  # numbers below 0 are apart from those of shared sequences
        {"sequence_id": -1 - F.col("pid"), "offset": F.lit(0).cast("long")}).select(*columns)
    return shared.unionAll(alone)
