"""Token-id output: fixed-size id blocks as byte or bit planes, each compressed with zstandard, with a chunk index."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, bounded_batches, shuffle_partitions, table, task, written
from .encoding import DEFAULT_VOCABULARY, END, encoder

MAGIC, BLOCK_IDS, LEVEL = b"PLN1", 1 << 16, 3
_HEADER = struct.Struct("<4sBBI")


def encode_block(ids: np.ndarray, planes: str = "byte", level: int = LEVEL) -> bytes:
    """Unsigned 32-bit ids as planes of equal significance, each compressed by itself.

    Header: magic, bits of a plane (8 or 1), number of planes, number of ids; then each plane's compressed size; then the planes.
    """
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4")
    if planes == "byte":
        rows = raw.view(np.uint8).reshape(-1, 4).T
    else:
        bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        rows = np.packbits(bits.T, axis=1, bitorder="little")
    packer = zstandard.ZstdCompressor(level=level)
    parts = [packer.compress(np.ascontiguousarray(r).tobytes()) for r in rows]
    head = _HEADER.pack(MAGIC, 8 if planes == "byte" else 1, len(parts), len(raw))
    return b"".join((head, struct.pack(f"<{len(parts)}I", *map(len, parts)), *parts))


def decode_block(data: bytes) -> np.ndarray:
    import zstandard

    magic, width, n_planes, n = _HEADER.unpack_from(data)
    if magic != MAGIC or (width, n_planes) not in ((8, 4), (1, 32)):
        raise ValueError("not a block of planes")
    sizes, at = struct.unpack_from(f"<{n_planes}I", data, _HEADER.size), _HEADER.size + 4 * n_planes
    unpacker, rows = zstandard.ZstdDecompressor(), []
    for size in sizes:
        rows.append(np.frombuffer(unpacker.decompress(data[at : at + size], max_output_size=max(1, n)), np.uint8))
        at += size
    if width == 8:
        return np.ascontiguousarray(np.stack(rows, 1)).view("<u4").ravel()
    bits = np.unpackbits(np.stack(rows), axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


#: A row is one block of a shard: its place, the planes, and which documents' ids it holds from where.
BLOCKS = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())), ("begins", pa.list_(pa.int32()))]
)
BLOCKS_SQL = "shard int, chunk int, first long, n_ids int, payload binary, doc_ids array<long>, ordinals array<long>, begins array<int>"


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, block_ids: int, planes: str) -> Iterator[pa.RecordBatch]:
    """Blocks of one shard; at most a batch's ids and one block are held."""
    encode, shard = encoder(vocabulary), TaskContext.get().partitionId()
    chunk, first, ordinal = 0, 0, 0
    held, n_held, docs = [], 0, []

    def flush() -> tuple:
        ids = np.frombuffer(b"".join(held), "<u4")
        return shard, chunk, first, len(ids), encode_block(ids, planes), [d[0] for d in docs], [d[1] for d in docs], [d[2] for d in docs]

    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
            raw, at = ids + END, 0
            while at < len(raw):
                docs.append((doc_id, ordinal, n_held))
                part = raw[at : at + 4 * (block_ids - n_held)]
                held.append(part)
                at += len(part)
                n_held += len(part) // 4
                if n_held == block_ids:
                    rows.append(flush())
                    chunk, first, held, n_held, docs = chunk + 1, first + n_held, [], 0, []
            ordinal += 1
        yield arrow_rows(BLOCKS, rows)
    if n_held:
        yield arrow_rows(BLOCKS, [flush()])


def write_token_files(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, block_ids: int = BLOCK_IDS, planes: str = "byte") -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order and write the blocks; the table read back has the columns of BLOCKS.

    Documents are dealt by ranges of doc_id, so shard numbers ascend with doc_id; within a shard rows are sorted. Null
    texts count as empty and hold the end id alone; rows of equal doc_id each keep their ids, in no fixed order among
    equals; rows of null doc_id come first. An empty table gives no block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(task(lambda it: _blocks(it, vocabulary, block_ids, planes), "encoder"), BLOCKS_SQL), "token-blocks")


def crc_combine(first: int, second: int, n_second: int) -> int:
    """crc32 of two byte strings put together, from their crc32 values and the second's length."""

    def times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit appended
    for _ in range(3):
        matrix = [times(matrix, x) for x in matrix]
    while n_second:
        if n_second & 1:
            first = times(matrix, first)
        matrix = [times(matrix, x) for x in matrix]
        n_second >>= 1
    return first ^ second


SPANS = pa.schema([("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its blocks.

    Blocks are decoded where they lie; only a few integers of each document move. The driver holds one integer a shard.
    """
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, at = {}, 0
    for shard, n in totals:
        before[shard], at = at, at + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b in batch.to_pylist():
                raw = decode_block(b["payload"]).tobytes()
                ends = [*b["begins"][1:], b["n_ids"]]
                base = before[b["shard"]] + b["first"]
                rows += [(b["shard"], o, d, base + x, y - x, zlib.crc32(raw[4 * x : 4 * y])) for d, o, x, y in zip(b["doc_ids"], b["ordinals"], b["begins"], ends, strict=True)]
            yield arrow_rows(SPANS, rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            if not len(parts):
                continue
            begin = np.concatenate(([0], np.cumsum(parts.value_lengths().to_numpy())))
            start, n, crc = (parts.flatten().field(c).to_numpy() for c in ("start", "n", "crc"))
            whole = crc[begin[:-1]].copy()
            for k in np.flatnonzero(np.diff(begin) > 1).tolist():  # the few documents that straddle blocks
                for p in range(begin[k] + 1, begin[k + 1]):
                    whole[k] = crc_combine(int(whole[k]), int(crc[p]), 4 * int(n[p]))
            columns = [batch.column("doc_id"), start[begin[:-1]], np.add.reduceat(n, begin[:-1]), whole]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], schema=READ)

    spans = blocks.mapInArrow(task(decode, "encoder"), "shard int, ordinal long, doc_id long, start long, n long, crc long")
    parts = spans.groupBy("shard", "ordinal", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))
    return parts.select("doc_id", "parts").mapInArrow(task(join, "encoder"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids as planes and read them back."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
