"""Best-fit decreasing packing of token pieces into fixed-size sequences.

Pieces of equal length are interchangeable, so the packing depends only on how many pieces of each length there are: at most
``capacity`` numbers, whatever the size of the corpus. Those counts are summed by Spark; best-fit decreasing then runs on
them, with a segment tree over the remaining capacities that finds the tightest open sequence in logarithmic time, and places
equal pieces into equal sequences in one step. The plan says which ranks of a length go to which sequences, and every piece
looks its place up by its rank among the pieces of its length; ranks come from counts per task, not from one sorted group.

**Edge cases.** A null or empty text is one piece that holds just the end id. Only documents longer than ``capacity`` are cut.
Rows that repeat, or whose doc_id is null, are packed like any other. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.memory import task as bounded
from ledgerloom.llm.tokens import SLICE_ROWS, with_end, word_encoder
from ledgerloom.session import materialise, ship

_RANK_BITS = 44


class CapacityTree:
    """A segment tree over 0..capacity that finds the smallest capacity, at least as large as asked, that has open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, open_: bool) -> None:
        node = capacity + self.size
        self.any[node] = open_
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.any[node]:
            return least
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(length, first rank, first sequence, offset)`` of each run of equal placements, and the number of sequences.

    A run goes on to the next first rank of its length: rank ``first rank + i`` is in sequence ``first sequence + i``.
    """
    tree, open_, plan, total = CapacityTree(capacity), defaultdict(list), [], 0

    def put(lo: int, hi: int, room: int) -> None:
        if room and lo < hi:
            open_[room].append((lo, hi))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                fits = room // length
                lo, total = total, total + -(-left // fits)
                hi = total
            else:
                fits = room // length
                lo, hi = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            # the tightest sequence stays the tightest until it is full for this length
            full = min(hi - lo, left // fits)
            for i in range(fits if full else 0):
                plan.append((length, rank, lo, capacity - room + i * length))
                rank += full
            put(lo, lo + full, room - fits * length)
            left, lo = left - full * fits, lo + full
            if lo < hi and 0 < left < fits:
                for i in range(left):
                    plan.append((length, rank, lo, capacity - room + i * length))
                    rank += 1
                put(lo, lo + 1, room - left * length)
                left, lo = 0, lo + 1
            put(lo, hi, room)
    return plan, total


def token_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, place)``: ``place`` counts the task's earlier pieces of that length."""
    ship(docs.sparkSession)

    def run(batches):
        encoder, task, seen = word_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, counts in encoder.batches(batch.column("text")):
                ids, counts = with_end(ids, counts, end_id)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, counts[doc] - start)
                begin = ((np.cumsum(counts) - counts)[doc] + start).tolist()
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(begin, length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(length[order]) != 0))
                size = np.diff(np.append(heads, len(order)))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order)) - np.repeat(heads, size) + seen[length[order]]
                seen[length[order][heads]] += size
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(first + doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(place)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(bounded(run, "words", SLICE_ROWS), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity, end_id, tokenizer), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = per_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    # one row for each length, so at most `capacity` of them
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    columns = np.array(plan, np.int64).reshape(-1, 4)
    key = (columns[:, 0] << _RANK_BITS) | columns[:, 1]
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], columns[order]))

    def place(batches):
        keys, found = shared.value
        for batch in batches:
            wanted = (batch.column("length").to_numpy() << _RANK_BITS) | batch.column("rank").to_numpy()
            run = found[np.searchsorted(keys, wanted, "right") - 1]
            rank = wanted & ((1 << _RANK_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before.select("length", "task", "base"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("base", F.lit(0)) + F.col("place")).alias("rank"))
    return ranked.mapInArrow(bounded(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
