"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive words of the benchmark items. Per pattern length there is a shift table:
for the block of words that ends at a position it says how far the search may jump without missing a pattern;
a block unknown to the table allows the longest jump. Where the shift is 0, the bucket of that block lists the
patterns that end with it, keyed by their first block, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, pure, rows, schema_with

#: Characters that separate words, after A-Z are lower-cased: ASCII but for digits and a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_OUT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(_UPPER)) if text else []


class WuManber:
    """Search for a set of word sequences, each with the items that it stands for, by tables from `build`."""

    def __init__(self, patterns: dict[tuple[str, ...], list[str]] | None = None, block: int = 3, tables: Tables | None = None):
        if tables is None:
            pieces = [(item, p) for p, items in patterns.items() for item in items]
            tables = build(pieces, max(map(len, patterns), default=1), block)
        self.vocabulary, self.names, self.groups = tables

    def matches(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Per group and chunk: starts of occurrences, their length, and the item codes of each with their bounds."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        hashes: dict[int, np.ndarray] = {}
        for patterns, size, shift, keys, bounds, codes in self.groups:
            length = patterns.shape[1]
            if size not in hashes:
                hashes[size] = _block_hashes(ids, size)
            own, before = hashes[size], length - size
            jumps = shift[own >> _shift_bits(shift)].tolist()
            reached, at, n = [], before, len(jumps)
            while at < n:
                move = jumps[at]
                if move:
                    at += move
                else:
                    reached.append(at)
                    at += 1
            if not reached:
                continue
            last = np.array(reached)
            key = _bucket(own[last - before], own[last])
            low = np.searchsorted(keys, key)
            many = np.searchsorted(keys, key, "right") - low
            total = np.cumsum(many)
            for part in np.split(np.arange(len(last)), np.flatnonzero(np.diff(total // _COMPARED)) + 1):
                count = many[part]
                start = np.repeat(last[part] - before, count)
                pattern = np.repeat(low[part], count) + np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
                same = (ids[start[:, None] + np.arange(length)] == patterns[pattern]).all(axis=1)
                if same.any():
                    yield start[same], length, codes, np.stack([bounds[pattern[same]], bounds[pattern[same] + 1]], axis=1)

    def search(self, words: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence of every pattern."""
        for starts, length, codes, bounds in self.matches(words):
            for start, (a, b) in zip(starts.tolist(), bounds.tolist()):
                yield start, start + length, [self.names[x] for x in codes[a:b].tolist()]

    def spans_and_items(self, words: list[str]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged ranges of the words that occurrences cover, and the sorted items."""
        spans, items = [], set()
        for starts, length, codes, bounds in self.matches(words):
            starts = np.unique(starts)
            breaks = np.flatnonzero(np.diff(starts) > length) + 1
            first, last = np.append(0, breaks), np.append(breaks, len(starts)) - 1
            spans += zip(starts[first].tolist(), (starts[last] + length).tolist())
            for a, b in np.unique(bounds, axis=0).tolist():
                items.update(codes[a:b].tolist())
        return merged(spans), sorted(self.names[x] for x in items)


#: Word -> number; item names; per pattern length: patterns as word numbers, block size, shift table, bucket keys, and item codes
#: by bounds per pattern.
Tables = tuple[dict[str, int], list[str], list[tuple]]

#: Pairs of a place and a pattern that are compared at a time.
_COMPARED = 1 << 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _block_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` word numbers from every place on; words that no pattern has count as one more word."""
    n = max(0, ids.shape[-1] - size + 1)
    out = np.zeros((*ids.shape[:-1], n), np.uint64)
    for k in range(size):
        out = (out + ids[..., k:k + n].astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out * _MULTIPLIER


def _shift_bits(table: np.ndarray) -> np.uint64:
    return np.uint64(65 - len(table).bit_length())


def _bucket(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Buckets go by the last block, and within it by the first."""
    return (last & ~np.uint64(0xFFFFFFFF)) | (first >> np.uint64(32))


def build(pieces: Iterable[tuple[str, Sequence[str]]], size: int, block: int = 3) -> Tables:
    """Tables for the windows of `size` words of all pieces, (item, words); a shorter piece that has words is one window.

    Words are numbered and all else lies in arrays, about 100 bytes a window of 10 words. Hashes only choose where to look: a slot
    of the shift table holds the least shift of the blocks that share it, and patterns are compared word by word.
    """
    vocabulary: dict[str, int] = {}
    names: dict[str, int] = {}
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, words in pieces:
        if words:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32)
            code = names.setdefault(item, len(names))
            by_length.setdefault(min(size, len(ids)), []).append((code, ids))
    groups = []
    for length, found in sorted(by_length.items()):
        every = np.concatenate([sliding_window_view(ids, length) for _, ids in found])
        owner = np.repeat(np.array([c for c, _ in found], np.int32), [len(ids) - length + 1 for _, ids in found])
        patterns, number = np.unique(every, axis=0, return_inverse=True)
        owners = np.unique(np.stack([number.reshape(-1).astype(np.int64), owner], axis=1), axis=0)
        width = min(block, length)
        hashes = _block_hashes(patterns, width)
        slots = 1 << max(8, int(4 * hashes.size).bit_length())
        shift = np.full(slots, length - width + 1, np.min_scalar_type(length))
        for k in range(hashes.shape[1]):  # the least shift of a slot is written last
            shift[hashes[:, k] >> _shift_bits(shift)] = length - width - k
        keys = _bucket(hashes[:, 0], hashes[:, -1])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owners[:, 0] = place[owners[:, 0]]
        owners = owners[np.argsort(owners[:, 0], kind="stable")]
        bounds = np.searchsorted(owners[:, 0], np.arange(len(patterns) + 1))
        groups.append((patterns[order], width, shift, keys[order], bounds, owners[:, 1].astype(np.int32)))
    return vocabulary, list(names), groups


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals, as sorted runs that neither overlap nor touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _pieces(benchmark: DataFrame, size: int, most_windows: int, most_bytes: int) -> DataFrame:
    """(item, piece, windows, bytes, words): items cut into pieces that share no window and lose none.

    A piece has at most `most_windows` windows, and at most about `most_bytes` of text but for one window's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in rows(batch):
                words = words_of(text)
                for number, (start, end) in enumerate(_cuts([len(w) for w in words], size, most_windows, most_bytes)):
                    joined = " ".join(words[start:end])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item]), pa.array([number], pa.int64()), pa.array([max(1, end - start - size + 1)], pa.int64()),
                        pa.array([len(joined.encode())], pa.int64()), pa.array([joined])],
                        ["item", "piece", "windows", "bytes", "words"])

    return benchmark.mapInArrow(run, "item string, piece long, windows long, bytes long, words string")


def _cuts(lengths: list[int], size: int, most_windows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Word ranges whose windows together are all windows, each once."""
    total = max(1, len(lengths) - size + 1) if lengths else 0
    start = 0
    while start < total:
        end, held = start, sum(lengths[start:start + size - 1])
        while end < total and end - start < most_windows and (end == start or held <= most_bytes):
            held += lengths[end + size - 1] if end + size - 1 < len(lengths) else 0
            end += 1
        yield start, min(len(lengths), end + size - 1)
        start = end


def _blocks(pieces: DataFrame, most_windows: int, most_bytes: int) -> list[tuple[int, list[int]]]:
    """Bins of pieces, by hash, put together into blocks within both bounds: (number of bins, bins of the block) each.

    Only bins' totals come to the driver. Bins are halved until each is within the bounds or holds one piece.
    """
    totals = pieces.agg(F.sum("windows"), F.sum("bytes")).first()
    load = max((totals[0] or 0) / most_windows, (totals[1] or 0) / most_bytes)
    n_bins = 1 if load <= 1 else 1 << (int(8 * load) - 1).bit_length()
    while True:
        bins = pieces.groupBy(_bin(n_bins).alias("bin")).agg(
            F.sum("windows").alias("windows"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("bin").collect()
        if all(b["n"] == 1 or (b["windows"] <= most_windows and b["bytes"] <= most_bytes) for b in bins):
            break
        n_bins *= 2
    blocks, windows_held, bytes_held = [], 0, 0
    for b in bins:
        if not blocks or windows_held + b["windows"] > most_windows or bytes_held + b["bytes"] > most_bytes:
            blocks.append([])
            windows_held = bytes_held = 0
        blocks[-1].append(b["bin"])
        windows_held, bytes_held = windows_held + b["windows"], bytes_held + b["bytes"]
    return [(n_bins, b) for b in blocks]


def _bin(n_bins: int) -> Column:
    return F.pmod(F.xxhash64("item", "piece", "words"), F.lit(n_bins))


def _pass(docs: DataFrame, pieces: DataFrame, size: int, block: int) -> DataFrame:
    """Every document against one block of pieces, whose size the caller has checked; the tables are built once."""
    own = ((r["item"], r["words"].split(" ")) for r in pieces.toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(build(own, size, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = WuManber(tables=shared.value)
        for batch in batches:
            counts, spans, hits = [], [], []
            for _, text in rows(batch):
                words = words_of(text)
                found, items = finder.spans_and_items(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in found])
                hits.append(items)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(hits, pa.list_(pa.string())),
            ], ["id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema_with(docs, _OUT))


def _merge_passes(passes: list[DataFrame]) -> DataFrame:
    """One row per document from its rows of all passes, which come with a number per document row."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged((x["start"], x["end"]) for x in found)]
                     for found in batch.column(2).to_pylist()]
            items = [sorted(set(found)) for found in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))],
                ["id", "n_words", "spans", "items"])

    every = passes[0]
    for other in passes[1:]:
        every = every.unionAll(other)
    parts = every.groupBy("copy").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return parts.select("id", "n_words", "spans", "items").mapInArrow(run, schema_with(parts, _OUT))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, block: int = 3, block_bytes: int = 32 << 20,
    block_windows: int = 1 << 19,
) -> DataFrame:
    """(id, n_words, spans, items) per row of `docs`: word ranges that lie in benchmark windows, and whose.

    `spans` are merged ranges of word numbers, end exclusive; `items` are ids as sorted strings. A null or
    wordless text has 0 words and no spans. Items without words, without text or without id match nothing;
    repeated items count once. Repeated rows give repeated rows. Other columns are ignored.

    The benchmark is the query set: its items are cut into pieces and broadcast in blocks of at most `block_windows` windows and
    `block_bytes` of words (a single window may be longer), as tables that are built once a block. Every block is matched against
    all documents, so memory is bounded for any number and length of items.
    """
    own = pure(docs, id=id_col, text=text_col)
    items = pure(benchmark, item=item_col, text=item_text_col).where("item is not null and text is not null").select(
        F.col("item").cast("string").alias("item"), "text").distinct()
    pieces = durable(_pieces(items, window, block_windows, block_bytes))
    blocks = _blocks(pieces, block_windows, block_bytes)
    if len(blocks) <= 1:
        found = _pass(own, pieces, window, block)
    else:
        passes = []
        numbered = durable(own.withColumn("id", F.struct("id", F.monotonically_increasing_id().alias("copy"))))
        for n_bins, bins in blocks:
            one = _pass(numbered, pieces.where(_bin(n_bins).isin(bins)), window, block)
            passes.append(one.select("id.id", "n_words", "spans", "items", F.col("id.copy").alias("copy")))
        found = _merge_passes(passes)
    return found.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, a hash of the items and the verdict from what `decontaminate` returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
