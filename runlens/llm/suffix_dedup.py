"""Removal of repeated passages: suffix arrays of the places where texts can agree, by two-stage sorting.

A byte goes when it lies in a `width`-byte string that also starts earlier. Equal strings of that width share their
smallest k-gram (by hash, leftmost), their anchor. So each text is cut into runs of windows with one anchor,
every window in exactly one run, and only runs with equal anchors can repeat each other:

1. a task that scans texts keeps the first place of equal runs; the later ones are repeats throughout;
2. what is left is dealt out by anchor, or by anchor and run where an anchor is frequent, and sorted by both, so that
   a stream over it finds the first place of each run, further repeats, and the anchors with several different runs;
3. the bytes of these runs meet in a task per anchor, which builds their suffix array by two-stage sorting:
   suffixes smaller than their successor are sorted directly, the others are induced by a scan of the buckets.
   Neighbours with a common prefix of `width` bytes are repeats of their first place.

An anchor with more runs than `block_runs` is not gathered; its windows go through steps 1 and 2 one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable_table, pure, rows, schema_with

WIDTH, GRAM = 100, 32

#: Windows of a text that are hashed at a time.
CHUNK = 1 << 18

#: Bytes of text among which a scan compares runs before they are dealt out.
SCAN_BYTES = 16 << 20
_BASE, _OTHER_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 20) - 1)


_RANGE = "doc long, row long, start long, end long"
_SCANNED, _SCANNED_NAMES = "anchor long, run long, doc long, row long, place long, end long", ["anchor", "run", "doc", "row", "place", "end"]


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def runs(data: bytes, tables: tuple[np.ndarray, np.ndarray], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, run hash, start, number of windows) of the runs of a text, in chunks.

    `tables` come from `powers(CHUNK + width)`.
    """
    n_windows, span = len(data) - width + 1, width - gram + 1
    power, inverse = tables
    for first in range(0, n_windows, CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK, n_windows - first) + width - 1, first).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power[:len(b)], dtype=np.uint64)])
        grams = _mixed((total[gram:] - total[:-gram]) * inverse[:len(b) - gram + 1])
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        at = (_sliding_min(keys, span) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(start, len(at)))
        anchor, end = at[start], start + count + width - 1
        whole = (total[end] - total[start]) * inverse[start]
        shape = ((anchor - start) << 32 | count).astype(np.uint64)
        yield grams[anchor].view(np.int64), _mixed(whole + _mixed(shape)).view(np.int64), start + first, count


def suffix_array(data: bytes, starts: list[int], ends: list[int], needed: list[int]) -> list[int]:
    """Sorted suffixes that start at the first `needed[k]` places of each segment `starts[k]:ends[k]`.

    A byte must stand between segments; suffixes end with their segment. Those smaller than their successor
    (type B) are sorted directly, the others (type A) are induced from their successors.
    """
    text = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    bounds = np.zeros(len(text) + 1, np.int16)
    bounds[:-1] = text
    bounds[np.array(ends)] = 0  # the end of a segment is smaller than any byte
    step = np.sign(np.diff(bounds))
    n = len(step)
    index = np.where(step != 0, np.arange(n), n)
    index = np.minimum.accumulate(index[::-1])[::-1]
    rising = np.append(step, -1)[index] > 0  # type B
    wanted = bytearray(n + 1)  # 1: type A in the domain
    direct: list[int] = []
    finals: list[int] = []
    b_places = np.flatnonzero(rising)
    for start, end, count in zip(starts, ends, needed):
        k = np.searchsorted(b_places, start + count)
        last = int(b_places[k]) if k < len(b_places) and b_places[k] < end else end
        inside = b_places[np.searchsorted(b_places, start):k].tolist()
        direct += [(p, end) for p in inside]
        if last < end:
            direct.append((last, end))
        else:
            finals.append(end)
        stretch = np.ones(last - start, np.uint8)
        stretch[np.array(inside, np.int64) - start] = 0
        wanted[start:last] = stretch.tobytes()
    direct.sort(key=lambda x: data[x[0]:x[1]])
    buckets: list[list[int]] = [[] for _ in range(256)]  # type A, in sorted order
    risen: list[list[int]] = [[] for _ in range(256)]
    for p, _ in direct:
        risen[data[p]].append(p)
    for end in finals:
        if end and wanted[end - 1]:
            buckets[data[end - 1]].append(end - 1)
    out: list[int] = []
    for c in range(256):
        for source in (buckets[c], risen[c]):
            for p in source:  # a bucket may grow while it is scanned
                out.append(p)
                if p and wanted[p - 1]:
                    buckets[data[p - 1]].append(p - 1)
    return out


def repeats(segments: list[tuple[int, int, int, bytes]], width: int = WIDTH) -> list[tuple[int, int, int, int]]:
    """(document, row, start, end) of window ranges that repeat an earlier window.

    A segment is (document, row, start, bytes); a range covers the bytes of its windows.
    """
    starts, ends, at = [], [], 0
    for *_, data in segments:
        starts.append(at)
        ends.append(at + len(data))
        at += len(data) + 1
    text = b"\0".join(s[3] for s in segments)
    needed = [len(s[3]) - width + 1 for s in segments]
    owner = np.repeat(np.arange(len(segments)), [len(s[3]) + 1 for s in segments])
    window = np.zeros(at, bool)
    for start, count in zip(starts, needed):
        window[start:start + count] = True
    order = np.array(suffix_array(text, starts, ends, needed), np.int64)
    order = order[window[order]]
    if len(order) < 2:
        return []
    places = order.tolist()
    same = np.fromiter((text[a:a + width] == text[b:b + width] for a, b in zip(places, places[1:])), bool, len(places) - 1)
    group = np.concatenate([[0], np.cumsum(~same)])
    document, first = (np.array([s[k] for s in segments]) for k in (0, 2))
    doc_of, start_of = document[owner[order]], first[owner[order]] + order - np.array(starts)[owner[order]]
    rank = np.lexsort((start_of, doc_of, group))
    leads = np.concatenate([[True], group[rank][1:] != group[rank][:-1]])
    lead = rank[np.maximum.accumulate(np.where(leads, np.arange(len(rank)), 0))]
    later = rank[(doc_of[rank] != doc_of[lead]) | (start_of[rank] != start_of[lead])]
    hit = np.zeros(at + 1, np.int8)
    hit[order[later]] = 1
    edges = np.diff(np.concatenate([[0], hit]))
    begin, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = []
    for a, b in zip(begin.tolist(), stop.tolist()):
        doc, row, base, _ = segments[owner[a]]
        out.append((doc, row, base + a - starts[owner[a]], base + b - 1 - starts[owner[a]] + width))
    return out


def _split(parts: list[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """First places of equal runs within a block, and the merged ranges of all later places; `end` is null for a place."""
    anchor, run, doc, row, place = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, doc, anchor, run))
    anchor, run, doc, row, place = (x[order] for x in (anchor, run, doc, row, place))
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (anchor[1:] != anchor[:-1])])
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(x[fresh]) for x in (anchor, run, doc, row, place)), pa.nulls(int(fresh.sum()), pa.int64())], _SCANNED_NAMES)
    lead = np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
    again = (doc != doc[lead]) | (place != place[lead])
    if not again.any():
        return
    doc, row, start, count = doc[again], row[again], place[again] >> 8, place[again] & 255
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    end = start + count[order] + width - 1
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > end[:-1])])
    last = np.concatenate([new[1:], [True]])
    ranges = [pa.array(x) for x in (doc[new], row[new], start[new], end[last])]
    yield pa.RecordBatch.from_arrays([*[pa.nulls(int(new.sum()), pa.int64())] * 2, *ranges], _SCANNED_NAMES)


def _places(scanned: DataFrame) -> DataFrame:
    return scanned.where("end is null").drop("end")


def _ranges(scanned: DataFrame) -> DataFrame:
    return scanned.where("end is not null").select("doc", "row", F.col("place").alias("start"), "end")


def _scan(own: DataFrame, width: int, gram: int) -> DataFrame:
    """First places of equal runs within a block of texts, and the merged ranges of all later places of the same block.

    A range has nulls for the anchor and the run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts, size = powers(CHUNK + width), [], 0
        for batch in batches:
            for doc, row, text in rows(batch):
                data = text.encode("utf-8", "surrogatepass")
                for anchor, whole, start, count in runs(data, tables, width, gram):
                    parts.append((anchor, whole, np.full(len(start), doc), np.full(len(start), row), start << 8 | count))
                size += len(data)
                if size >= SCAN_BYTES and parts:
                    yield from _split(parts, width)
                    parts, size = [], 0
        if parts:
            yield from _split(parts, width)

    return own.mapInArrow(run, _SCANNED)


def _scan_windows(segments: DataFrame, width: int) -> DataFrame:
    """First places and later ranges, as of one cut into blocks, of the single windows of crowded segments.

    Each window is a run of its own, named by two hashes. A range has nulls for the anchor and the run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, parts, size = [powers(CHUNK + width, base) for base in (_BASE, _OTHER_BASE)], [], 0
        for batch in batches:
            for _, _, doc, row, start, data in rows(batch):
                b = np.frombuffer(data, np.uint8).astype(np.uint64)
                n = len(b) - width + 1
                names = []
                for power, inverse in tables:
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power[:len(b)], dtype=np.uint64)])
                    names.append(_mixed((total[width:] - total[:-width]) * inverse[:n]).view(np.int64))
                parts.append((*names, np.full(n, doc), np.full(n, row), (start + np.arange(n)) << 8 | 1))
                size += n
                if size >= SCAN_BYTES // 32:
                    yield from _split(parts, width)
                    parts, size = [], 0
        if parts:
            yield from _split(parts, width)

    return segments.mapInArrow(run, _SCANNED)


def _grouped(places: DataFrame, width: int, hot: DataFrame | None = None) -> DataFrame:
    """From first places: ranges of places that are not the first of their run, and runs whose anchor has others.

    A run to compare has its number among the runs of its anchor, from 0, in `number`; a range has null there.
    The runs of a `hot` anchor are dealt out one by one; each is given, without being counted, with the number -1.
    """
    columns = ("anchor", "run", "doc", "row", "place")
    if hot is None:
        dealt = places.select(*columns, F.lit(False).alias("hot")).repartition("anchor")
    else:
        dealt = places.join(hot.select("anchor", F.lit(True).alias("hot")), "anchor", "left").select(
            *columns, F.coalesce("hot", F.lit(False)).alias("hot"))
        dealt = dealt.repartition("anchor", F.when(F.col("hot"), F.col("run")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the first row of the current run, and the number of runs of its anchor so far
        number, waiting = 0, None
        for batch in batches:
            anchor, whole, doc, row, place, alone = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            out: list[tuple] = []
            n = len(anchor)
            if not n:
                continue
            fresh = np.ones(n, bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
            fresh[0] = first is None or (anchor[0], whole[0]) != first[:2]
            heads = np.flatnonzero(fresh).tolist()
            lead_doc, lead_place = np.empty(n, np.int64), np.empty(n, np.int64)
            if not fresh[0]:
                lead_doc[0], lead_place[0] = first[2], first[4]
            lead_doc[fresh], lead_place[fresh] = doc[fresh], place[fresh]
            at = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            lead_doc, lead_place = lead_doc[at], lead_place[at]
            for k in heads:
                head = (int(anchor[k]), int(whole[k]), int(doc[k]), int(row[k]), int(place[k]))
                if alone[k]:
                    waiting = None
                    out.append((head, -1))
                elif first is not None and head[0] == first[0]:
                    if waiting is not None:
                        out.append((waiting, 0))
                        waiting = None
                    number += 1
                    out.append((head, number))
                else:
                    number, waiting = 0, head
                first = head
            copied = (doc != lead_doc) | (place != lead_place)
            start, count = place[copied] >> 8, place[copied] & 255
            n_out, n_copied = len(out), int(copied.sum())
            listed = [np.array([h[k] for h, _ in out], np.int64) for k in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(listed[0]), pa.nulls(n_copied, pa.int64())]),
                pa.concat_arrays([pa.array([x for _, x in out], pa.int64()), pa.nulls(n_copied, pa.int64())]),
                pa.array(np.concatenate([listed[1], doc[copied]])), pa.array(np.concatenate([listed[2], row[copied]])),
                pa.array(np.concatenate([listed[3] >> 8, start])),
                pa.array(np.concatenate([(listed[3] >> 8) + (listed[3] & 255), start + count]) + (width - 1)),
            ], ["anchor", "number", "doc", "row", "start", "end"])

    return dealt.sortWithinPartitions("anchor", "run", "doc", "place").mapInArrow(
        run, "anchor long, number long, " + _RANGE)


def _segments(own: DataFrame, chosen: DataFrame) -> DataFrame:
    """The bytes of the chosen runs, which are brought to their texts as one list per text.

    `lot` is 0, or for a crowded anchor a number from 1 on that spreads its runs.
    """
    lists = chosen.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "start", "end", "crowded")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                out = []
                for doc, row, text, own_runs in zip(*(c.to_pylist() for c in batch.slice(at, 32).columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    out += [(r["anchor"], 1 + doc % 256 if r["crowded"] else 0, doc, row, r["start"], data[r["start"]:r["end"]])
                            for r in own_runs]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 5 + [pa.binary()])],
                        ["anchor", "lot", "doc", "row", "start", "data"])

    return own.join(lists, ["doc", "row"]).select("doc", "row", "text", "runs").mapInArrow(
        run, "anchor long, lot long, doc long, row long, start long, data binary")


def _sorted_repeats(segments: DataFrame, width: int, block_bytes: int = 1 << 20) -> DataFrame:
    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeats([x[2:] for x in held], width)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*found)], ["doc", "row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in rows(batch):
                if size > block_bytes and r[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield from solve(held)

    return segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RANGE)


def repeated_ranges(own: DataFrame, width: int = WIDTH, gram: int = GRAM, block_runs: int = 20_000) -> DataFrame:
    """(doc, row, start, end): byte ranges of (doc, row, text) rows that repeat earlier ones; they may overlap."""
    long = own.where(F.octet_length("text") >= width)
    # a copy is left out of the places because its block holds an earlier one, so the same cut must also mark it
    scanned = durable_table(_scan(long, width, gram))
    # no anchor with fewer places can have more than `block_runs` runs; the runs of the others are dealt out
    often = durable_table(_places(scanned).groupBy("anchor").count().where(F.col("count") > block_runs).select("anchor"))
    hot = often if often.limit(1).count() else None
    grouped = durable_table(_grouped(_places(scanned), width, hot))
    ranges = _ranges(scanned).unionAll(grouped.where("number is null").select("doc", "row", "start", "end"))
    runs_ = grouped.where("number is not null").drop("number")
    crowded = grouped.where("number = -1").groupBy("anchor").count().where(F.col("count") > block_runs).select("anchor")
    some = hot is not None and crowded.limit(1).count() > 0
    mark = F.lit(True).alias("crowded")
    marked = runs_.join(crowded.select("anchor", mark), "anchor", "left") if some else runs_.withColumn("crowded", F.lit(False))
    segments = _segments(own, marked)
    if not some:
        return ranges.unionAll(_sorted_repeats(segments, width))
    segments = durable_table(segments)
    windows = durable_table(_scan_windows(segments.where("lot > 0").repartition("anchor", "lot"), width))
    single = _grouped(_places(windows), width).where("number is null").select("doc", "row", "start", "end")
    return ranges.unionAll(_sorted_repeats(segments.where("lot = 0"), width)).unionAll(_ranges(windows)).unionAll(single)


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
    block_runs: int = 20_000, with_text: bool = False,
) -> DataFrame:
    """(id, n_bytes, removed, kept_sha256[, kept]) per row; `removed` holds the maximal removed byte ranges.

    Every byte in a `width`-byte string that also starts earlier goes: in a document with a smaller id or at an
    earlier start of the same one. Null texts are empty and lose nothing, like texts shorter than `width`.
    Ids are integers below 2**63 - 1. Rows that share an id count as one document whose starts are compared; rows without an
    id count as one document after all others. Other columns are ignored. `with_text` adds the bytes kept.
    """
    named = pure(docs, id=id_col, text=text_col)
    last = (1 << 63) - 1
    shared = named.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").limit(1).count()
    token = F.xxhash64("text").bitwiseOR(F.lit(1))  # tells rows of one id apart; 0 where ids do
    row = token if shared else F.when(F.col("id").isNull(), token).otherwise(F.lit(0).cast("long"))
    own = named.select("id", F.coalesce("text", F.lit("")).alias("text")).select(
        F.coalesce(F.col("id").cast("long"), F.lit(last)).alias("doc"), row.alias("row"), "text")
    ranges = repeated_ranges(own, width, gram, block_runs)
    lists = ranges.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    back = F.when((F.col("doc") == last) & (F.col("row") != 0), F.lit(None)).otherwise(F.col("doc"))
    joined = own.join(lists, ["doc", "row"], "left").select(
        back.cast(named.schema["id"].dataType).alias("id"), "text", "ranges")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, removed, digests, left = [], [], [], []
                for _, text, found in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for start, end in sorted((r["start"], r["end"]) for r in found or ()):
                        if merged and start <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], end)
                        else:
                            merged.append([start, end])
                    edges = [0, *(x for m in merged for x in m), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    sizes.append(len(data))
                    removed.append([{"start": a, "end": b} for a, b in merged])
                    digests.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept)
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pair), pa.array(digests, pa.string())]
                names = ["id", "n_bytes", "removed", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(left, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    fields = "n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(run, schema_with(joined, fields)).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select(id_col, "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
