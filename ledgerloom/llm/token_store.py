"""Token ids in patched frame-of-reference segments.

**Format.** The table has one row per segment: ``part`` and ``segment`` number it, ``start_in_part`` counts the part's earlier ids,
``doc_ids`` and ``doc_counts`` list its whole documents (little-endian signed 64-bit and unsigned 32-bit), ``doc_nulls`` their null ids,
and ``body`` holds the ids in blocks of 128::

    count, blocks      unsigned 32-bit each
    block starts       unsigned 32-bit for each block and the end: the index into the packed bytes
    block minimum      unsigned 32-bit for each block
    block width        one byte for each block: the bits of its percentile of (id - minimum)
    exceptions         one byte for each block: how many values need more bits
    packed bytes       for each block ``width`` bit planes of 16 bytes, lowest bit first
    exception places   one byte each, then their high parts, unsigned 32-bit each

The last block is filled up with its last id. Files are Parquet, so any store that Spark writes to will do, task commit makes lost
executors harmless, and a block can be read on its own through its segment's index.

**Order.** Documents are range-partitioned and sorted by doc_id (nulls first), then by a hash of the text and the place in the read, so that a
doc_id that very many rows share is spread over parts. Parts are numbered in that order, so the ids before a document are those of earlier parts, earlier segments of its part, and earlier documents of its segment.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.memory import task
from ledgerloom.llm.tokens import SLICE_ROWS, with_end, word_encoder
from ledgerloom.session import scratch_path, ship, tasks

BLOCK = 128
SEGMENT_IDS = 1 << 17
_SCHEMA = "part int, segment int, start_in_part long, doc_ids binary, doc_counts binary, doc_nulls binary, body binary"


def encode_ids(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """One segment body."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    values = padded.reshape(blocks, BLOCK)
    least = values.min(axis=1, initial=0xFFFFFFFF) if blocks else np.zeros(0, np.uint32)
    values = values - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    top = np.partition(values, at, axis=1)[:, at] if blocks else least
    width = np.where(top > 0, np.floor(np.log2(np.maximum(top, 1).astype(float))).astype(np.int64) + 1, 0)
    starts = np.concatenate(([0], np.cumsum(width * (BLOCK // 8)))).astype("<u4")
    high = values.astype(np.uint64) >> width.astype(np.uint64)[:, None]
    block, place = np.nonzero(high)
    packed = np.empty(int(starts[-1]), np.uint8)
    for plane in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > plane)
        bits = np.packbits((values[some] >> np.uint32(plane)).astype(np.uint8) & 1, axis=1)
        packed[(starts[some].astype(np.int64) + plane * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)] = bits
    return b"".join((np.array([n, blocks], "<u4").tobytes(), starts.tobytes(), least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), np.bincount(block, minlength=blocks).astype(np.uint8).tobytes(), packed.tobytes(), place.astype(np.uint8).tobytes(), high[block, place].astype("<u4").tobytes()))


def decode_ids(body: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a segment body, or of blocks ``first_block`` to before ``last_block``; other blocks are not unpacked."""
    n, blocks = np.frombuffer(body, "<u4", 2).tolist()
    last_block = blocks if last_block is None else min(last_block, blocks)
    if not n or first_block >= last_block:
        return np.zeros(0, np.uint32)
    at = 8
    starts = np.frombuffer(body, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    least = np.frombuffer(body, "<u4", blocks, at)
    at += 4 * blocks
    width = np.frombuffer(body, np.uint8, blocks, at).astype(np.int64)
    at += blocks
    exceptions = np.frombuffer(body, np.uint8, blocks, at).astype(np.int64)
    at += blocks
    packed = np.frombuffer(body, np.uint8, int(starts[-1]), at)
    at += int(starts[-1])
    total = int(exceptions.sum())
    skipped, wanted = int(exceptions[:first_block].sum()), int(exceptions[first_block:last_block].sum())
    place = np.frombuffer(body, np.uint8, total, at)[skipped : skipped + wanted]
    high = np.frombuffer(body, "<u4", total, at + total)[skipped : skipped + wanted]
    own = slice(first_block, last_block)
    width, starts, least = width[own], starts[:-1][own], least[own]
    values = np.zeros((len(width), BLOCK), np.uint32)
    for plane in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > plane)
        bits = np.unpackbits(packed[(starts[some] + plane * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)], axis=1)
        values[some] |= bits.astype(np.uint32) << np.uint32(plane)
    block = np.repeat(np.arange(len(width)), exceptions[own])
    values[block, place] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    values += least[:, None]
    return values.reshape(-1)[: min(n, last_block * BLOCK) - first_block * BLOCK]


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Encode every whole text, append ``end_id`` to each document, and write all ids in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_text": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    ordered = ordered.repartitionByRange(tasks(spark), "doc_id", "_text", "_place").sortWithinPartitions("doc_id", "_text", "_place").drop("_text", "_place")

    def run(batches):
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        held, count, done, number = [], 0, 0, 0

        def segment():
            ids, counts, docs_ = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])
            row = [part, number, done, docs_.fill_null(0).to_numpy().astype("<i8").tobytes(), counts.astype("<u4").tobytes(), np.packbits(docs_.is_null().to_numpy(zero_copy_only=False)).tobytes(), encode_ids(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for first, ids, counts in encoder.batches(batch.column("text")):
                ids, counts = with_end(ids, counts, end_id)
                ends = np.cumsum(counts)
                a = 0
                while a < len(counts):
                    before = int(ends[a] - counts[a])
                    b = max(a + 1, int(np.searchsorted(ends, before + SEGMENT_IDS - count, "right")))
                    held.append((ids[before : ends[b - 1]], counts[a:b], batch.column("doc_id").slice(first + a, b - a)))
                    count += int(ends[b - 1]) - before
                    a = b
                    if count >= SEGMENT_IDS or a < len(counts):
                        yield segment()
                        held, count, done, number = [], 0, done + count, number + 1
        if held:
            yield segment()

    ordered.mapInArrow(task(run, "words", SLICE_ROWS), _SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids array<long>", lambda ids, a, b: ids[a:b])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids, a, b: zlib.crc32(ids[a:b]))


def _read(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    ship(spark)
    stored = spark.read.schema(_SCHEMA).parquet(path)
    # one row per part, that is per writing task
    bases, total = [], 0
    sizes = stored.groupBy("part").agg(F.max(F.struct("start_in_part", F.substring("body", 1, 4).alias("last"))).alias("m")).orderBy("part").collect()
    for r in sizes:
        bases.append((r["part"], total))
        total += r["m"]["start_in_part"] + int.from_bytes(r["m"]["last"], "little")
    table = spark.createDataFrame(bases, "part int, base long")
    name = schema.split()[-2]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode_ids(batch.column("body")[i].as_py())
                counts = np.frombuffer(batch.column("doc_counts")[i].as_py(), "<u4").astype(np.int64)
                null = np.unpackbits(np.frombuffer(batch.column("doc_nulls")[i].as_py(), np.uint8), count=len(counts)).astype(bool)
                begin = np.cumsum(counts) - counts
                values = [value(ids, a, a + n) for a, n in zip(begin.tolist(), counts.tolist(), strict=True)]
                kind = pa.int64() if name == "ids_crc32" else pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column("doc_ids")[i].as_py(), "<i8"), mask=null), pa.array(begin + batch.column("base")[i].as_py() + batch.column("start_in_part")[i].as_py()), pa.array(counts), pa.array(values, kind)], ["doc_id", "start", "n_tokens", name])

    return stored.join(F.broadcast(table), "part").select("base", "start_in_part", "doc_ids", "doc_counts", "doc_nulls", "body").mapInArrow(task(run), schema)


def token_table(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids to files in the shared folder, read the files back, and return their digests."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, end_id, tokenizer)
    return token_digests(docs.sparkSession, path)
