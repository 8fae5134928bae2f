"""Questions from blocks of documents to a corpus-wide table of keys, and the answers back to the blocks.

Some operators must know, for very many short strings of every document, a fact about the whole corpus:
how often a word pair occurs, in which document a string occurs first. One row for each occurrence would
multiply the corpus. Instead documents are packed into blocks once (a table in the warehouse, bucketed by block, so
that no later step shuffles texts). Each block asks about its distinct keys, already summed up: a key that
is everywhere is asked once a block, so no key is hot. Questions are shuffled by key range, summed, and the
answers are shuffled back by block, in the order of the block's sorted keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta

BLOCK_BYTES, RANGES_PER_PARTITION = 4 << 20, 2
REQUEST = "kind int, bucket int, block bigint, asked binary"
REPLY = "kind int, bucket int, block bigint, reply binary"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in arrays))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    """The arrays of pack(), all of one length, of these types."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _pack_keys(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane, which compresses; then the values."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), *values)


def _unpack_keys(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // (8 + sum(np.dtype(t).itemsize for t in types))
    planes = np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n)
    out, at = [np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)], 8 * n
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


class Blocks:
    """Documents in blocks; use as a context, which drops the table at its end."""

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.spark: SparkSession = docs.sparkSession
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = self.partitions * RANGES_PER_PARTITION
        self.name = f"covara_blocks_{uuid.uuid4().hex}"
        self.tables = [self.name]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 33
            for batch in batches:
                for part in ta.slices(batch, most=block_bytes):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()])], names=["block", "payload"])
                    block += 1

        (docs.mapInArrow(cut, "block bigint, payload binary").write.option("compression", "none").bucketBy(self.partitions, "block").saveAsTable(self.name))

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def each(self, work: Callable[[int, pa.RecordBatch, list], Iterator[pa.RecordBatch]], schema: str, *replies: DataFrame) -> DataFrame:
        """work(block, documents, for each of the replies a dict of kind -> blobs in key order) for every block."""
        rows = self.spark.table(self.name)
        for i, reply in enumerate(replies):
            gathered = reply.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "reply"))).alias(f"r{i}"))
            rows = rows.join(gathered.hint("shuffle_hash"), "block", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    given = []
                    for column in batch.columns[2:]:
                        by_kind: dict[int, list[bytes]] = {}
                        for x in column[i].as_py() or ():
                            by_kind.setdefault(x["kind"], []).append(x["reply"])
                        given.append(by_kind)
                    with pa.ipc.open_stream(batch.column(1)[i].as_buffer()) as r:
                        docs = r.read_all().combine_chunks().to_batches()
                    for d in docs:
                        yield from work(batch.column(0)[i].as_py(), d, given)

        return rows.mapInArrow(run, schema)

    def answer(self, requests: DataFrame, ops: Sequence[tuple[np.ufunc, str, str]], totals: Callable[[int, list[np.ndarray]], bytes] | None = None) -> DataFrame:
        """Rows of REPLY: for each asked key its values over all blocks, each combined by its (ufunc, type asked, type replied).

        totals(kind, combined values of a range's distinct keys) may add a row of its own with block -1. The result is a
        table bucketed by block like the texts, so that no step that reads it shuffles either.
        """

        def combine(table: pa.Table) -> pa.Table:
            parts = [_unpack_keys(x, *(t for _, t, _ in ops)) for x in table.column("asked").to_pylist()]
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            new = np.concatenate([[True], np.diff(keys[order]) != 0])
            first, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
            place[order] = np.cumsum(new) - 1
            whole = [op.reduceat(np.concatenate([p[i + 1] for p in parts])[order].astype(t), first) for i, (op, _, t) in enumerate(ops)]
            kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
            at, blocks, replies = 0, table.column("block").to_pylist(), []
            for p in parts:
                own = place[at : at + len(p[0])]
                replies.append(pack(*(w[own] for w in whole)))
                at += len(own)
            if totals:
                blocks, replies = [*blocks, -1], [*replies, totals(kind, whole)]
            n = len(blocks)
            return pa.table([pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(blocks, pa.int64()), pa.array(replies, pa.binary())], names=["kind", "bucket", "block", "reply"])

        self.tables.append(name := f"{self.name}_{len(self.tables)}")
        found = requests.groupBy("kind", "bucket").applyInArrow(combine, REPLY).repartition(self.partitions, "block")
        found.write.option("compression", "none").bucketBy(self.partitions, "block").saveAsTable(name)
        return self.spark.table(name)


def block_requests(buckets: int, kind: int, block: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """Rows of REQUEST for ascending distinct keys of a block, with a value array for each."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield kind, int(bucket[a]), block, _pack_keys(keys[a:b], *(v[a:b] for v in values))


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, block, asked = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(asked, pa.binary())], names=["kind", "bucket", "block", "asked"])


def read_reply(blobs: list[bytes] | None, *types: str) -> list[np.ndarray]:
    """The replies of all key ranges of a block, in the order of its keys."""
    parts = [unpack(x, *types) for x in blobs or ()]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate(types)]
