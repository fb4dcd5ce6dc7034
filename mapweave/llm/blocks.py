"""Looking up what a corpus holds for every n-gram of every document, with little data on the move.

Documents are packed into blocks of a few MB. A block asks each key bucket about its distinct keys
once (a sorted, delta-coded, compressed array), the bucket answers with an array in the same order.
So a frequent key costs a block one entry however often it occurs, no group of rows per key is ever
formed, and what a task holds is bounded by the size of a block or of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from mapweave.llm.session import documents, prepare, release, stable
from mapweave.llm.words import U

#: Bytes of text in a block, and per key bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20
BLOCKS = "block long, docs binary"
REQUESTS = "bucket long, block long, part int, keys binary"


def deflate(x: np.ndarray, level: int = 1) -> bytes:
    """An array, its bytes dealt out by significance first, so that leading zeros compress."""
    if not len(x):
        return b""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def inflate(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def deflate_sorted(x: np.ndarray) -> bytes:
    """A rising array of unsigned numbers."""
    return deflate(np.diff(x, prepend=x.dtype.type(0)))


def inflate_sorted(b: bytes, kind=U) -> np.ndarray:
    return np.cumsum(inflate(b, kind), dtype=kind)


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The documents as blocks (block, docs), to be unpacked with ``unpacked``, and the bytes of all texts.

    Blocks are not written: packing again costs less than moving texts to disk and back.
    """
    prepare(docs.sparkSession)
    docs = stable(documents(docs))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, held_bytes, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"block": pa.array([base + made], pa.int64()), "docs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            batch = batch.select(["doc_id", "text"]).cast(pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())]))
            sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch["text"]])
            start = 0
            while start < batch.num_rows:
                before = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + block_bytes - held_bytes, "right")))
                held.append(batch.slice(start, stop - start))
                held_bytes += int(sizes[stop - 1]) - before
                start = stop
                if start < batch.num_rows or held_bytes >= block_bytes:
                    yield block()
                    held, held_bytes, made = [], 0, made + 1
        if held:
            yield block()

    return docs.mapInArrow(pack, BLOCKS), total


def unpacked(block: bytes) -> tuple[list[int | None], list[bytes | None]]:
    table = pa.ipc.open_stream(block).read_all()
    return table["doc_id"].to_pylist(), table["text"].to_pylist()


def bucket_count(total: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Key buckets in proportion to the corpus, so that a bucket's share stays the same at every size."""
    return max(8, -(-total // bucket_bytes))


def bucket_bounds(sorted_keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Where each of n equal key ranges starts and ends in a rising array of keys below 2**bits."""
    edges = np.array([(i << bits) // n for i in range(1, n)], U)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def framed(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(4, "big") + first + second


def unframed(both: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(both[:4], "big")
    return both[4 : 4 + n], both[4 + n :]


def requested(blocks: DataFrame, ask: Callable[[bytes], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Requests of every block; ``ask(docs)`` yields (bucket, part, keys) for one block."""

    def run(batches):
        for batch in batches:
            for block, docs in zip(batch["block"].to_pylist(), batch["docs"].to_pylist(), strict=True):
                rows = list(ask(docs))
                if rows:
                    yield request_batch(block, rows)
                release()

    return blocks.select("block", "docs").mapInArrow(run, REQUESTS)


def request_batch(block: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, part, keys = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(part, pa.int32()), pa.array(keys, pa.binary())], names=["bucket", "block", "part", "keys"])


def answered(requests: DataFrame, answer: Callable[[list[int], list[bytes]], tuple[list[bytes], list[int]]]) -> DataFrame:
    """One reply per request: ``answer(parts, keys)`` sees all requests of one bucket, in any order.

    It returns the replies in that order, and two totals of the bucket (kept on its first row).
    """
    schema = "block long, bucket long, part int, reply binary, total_a long, total_b long"

    def run(table: pa.Table) -> pa.Table:
        release()  # what the last bucket left
        replies, (a, b) = answer(table["part"].to_pylist(), table["keys"].to_pylist())
        rest = [0] * (table.num_rows - 1)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "part": table["part"], "reply": pa.array(replies, pa.binary()), "total_a": pa.array([a, *rest], pa.int64()), "total_b": pa.array([b, *rest], pa.int64())})

    return requests.groupBy("bucket").applyInArrow(run, schema)


def met(blocks: DataFrame, replies: DataFrame, use: Callable[[bytes, dict[int, dict[int, bytes]]], pa.Table], schema: str, keep_block: bool = False) -> DataFrame:
    """``use(docs, {part: {bucket: reply}})`` for every block and the replies to it; with ``keep_block`` a column ``block`` is added."""
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        release()  # what the last block left
        got: dict[int, dict[int, bytes]] = {}
        for bucket, part, reply in zip(right["bucket"].to_pylist(), right["part"].to_pylist(), right["reply"].to_pylist(), strict=True):
            got.setdefault(part, {})[bucket] = reply
        out = pa.concat_tables(use(x, got) for x in left["docs"].to_pylist())
        if keep_block:
            out = out.append_column("block", pa.array(left["block"].to_pylist()[:1] * out.num_rows, pa.int64()))
        return out.select(empty.names).cast(empty)

    return blocks.select("block", "docs").groupBy("block").cogroup(replies.select("block", "bucket", "part", "reply").groupBy("block")).applyInArrow(run, schema)
