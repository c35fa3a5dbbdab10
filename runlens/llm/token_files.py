"""Token ids of documents as Arrow stream files of equal-length sequences.

Documents are sorted by id over range partitions. Every task tokenises its range and writes one file: record batches of
two fixed-size-list columns, `ids` and `mask`, `length` values a row. Documents follow each other without gaps; only
the last sequence of a file is filled up, and its mask says so. Values are not compressed, so a reader that maps
the file has every sequence as a view of it: sequence k is row `k % BATCH` of batch `k // BATCH`.

A file gets a name of its own for every attempt of its task, and the index, a table that Spark commits, names the
files that count. What a lost or repeated attempt leaves behind is named nowhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import checkpoint_folder, durable_table, pure, rows, schema_with
from runlens.llm.packing import Encoder

LENGTH, END, BATCH = 1024, 2, 512


def ids_type(vocabulary: int) -> pa.DataType:
    """The smallest unsigned type that holds every id."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def file_schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch; holds one batch at most."""

    def __init__(self, path: str, kind: pa.DataType, length: int):
        files, place = fs.FileSystem.from_uri(path)
        files.create_dir(place.rpartition("/")[0], recursive=True)
        self.schema, self.kind, self.length = file_schema(kind, length), kind.to_pandas_dtype(), length
        self.out = files.open_output_stream(place)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.held, self.n_held, self.written = np.zeros(BATCH * length, self.kind), 0, 0

    def add(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at:at + len(self.held) - self.n_held]
            self.held[self.n_held:self.n_held + len(part)] = part
            self.n_held += len(part)
            at += len(part)
            if self.n_held == len(self.held):
                self.flush()
        self.written += len(ids)

    def flush(self) -> None:
        n = -(-self.n_held // self.length) * self.length
        self.held[self.n_held:n] = 0
        columns = [pa.array(self.held[:n]), pa.array(np.arange(n) < self.n_held)]
        lists = [pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_held = 0

    def close(self) -> None:
        if self.n_held:
            self.flush()
        self.stream.close()
        self.out.close()


class Sequences:
    """Random access to the sequences of a file. A local file is mapped, and what is returned are views of it."""

    def __init__(self, path: str):
        files, place = fs.FileSystem.from_uri(path)
        source = pa.memory_map(place) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(place)
        self.batches = list(pa.ipc.open_stream(source))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence k, the ids as a view."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, row = self.batches[k // BATCH], k % BATCH
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values


def _stream(path: str) -> Iterator[np.ndarray]:
    """Ids of a file, a batch at a time, without what fills up the last sequence."""
    files, place = fs.FileSystem.from_uri(path)
    with files.open_input_stream(place) as source:
        for batch in pa.ipc.open_stream(source):
            ids, mask = (batch.column(k).flatten() for k in (0, 1))
            yield ids.to_numpy(zero_copy_only=True)[:mask.true_count]


def write_tokens(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end: int = END, length: int = LENGTH,
) -> DataFrame:
    """(id, shard, file, place, n_tokens) per row of `docs`: its ids lie in `file` from `place` on, the end token included.

    Files are written below `folder`, which all machines share (default: the checkpoint folder); in the order of their
    shards they hold the documents by ascending id. Null ids come first; rows of one id are in the order of
    their texts' hashes. A null or empty text is the end token alone. Repeated rows are written like others. Other
    columns are ignored. An empty table gives no file and an empty index.
    """
    own = pure(docs, id=id_col, text=text_col)
    base = f"{(folder or checkpoint_folder(docs)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    keys = [F.asc_nulls_first("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    kept = schema_with(own, "text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        shard = TaskContext.get().partitionId()
        path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = Encoder(tokenizer_path)
                kind = ids_type(max(encoder.size, end + 1))
                writer = Writer(path, kind, length)
            places, counts = [], []
            for _, text in rows(batch):
                places.append(writer.written)
                writer.add(np.array([*encoder.ids(text or ""), end], writer.kind))
                counts.append(writer.written - places[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([path] * n), pa.array(places, pa.int64()),
                 pa.array(counts, pa.int64())], ["id", "shard", "file", "place", "n_tokens"])
        if writer:
            writer.close()

    ordered = own.repartitionByRange(*keys).sortWithinPartitions(*keys[:2]).select(*kept.names)
    return durable_table(ordered.mapInArrow(run, schema_with(own, "shard int, file string, place long, n_tokens long")))


def read_tokens(index: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per row of the index, from the files; `start` counts the ids of all documents before.

    A file is read once, by one task and a batch at a time.
    """
    total = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))  # one row per file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, held = None, iter(()), np.zeros(0, np.uint16)
        for batch in batches:
            codes = []
            for path, place, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if path != file:
                    file, stream, held, at = path, _stream(path), np.zeros(0, np.uint16), 0
                if place != at:
                    raise ValueError(f"{path} has no document at {place}")
                at, code = place + n, 0
                while n:
                    if not len(held):
                        held = next(stream)
                    part, held = held[:n], held[n:]
                    code = zlib.crc32(part.astype("<u4").tobytes(), code)
                    n -= len(part)
                codes.append(code)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], [*batch.schema.names, "ids_crc32"])

    told = index.select("id", "file", "place", "n_tokens").repartition("file").sortWithinPartitions("file", "place")
    read = told.mapInArrow(run, schema_with(index, "file string, place long, n_tokens long, ids_crc32 long"))
    return read.join(F.broadcast(bases), "file").select(
        "id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
