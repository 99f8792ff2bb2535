"""Byte grams of Arrow text batches as 64-bit hashes, and fixed-size bitmaps of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)
BITS = 26


def gram_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the ``size`` bytes from every place on, for grams within one text, and the text's number for each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    n = len(bytes_) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _STEP
        out += bytes_[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    length = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(length)), length)
    begin = np.repeat(offsets[:-1] - offsets[0] - (np.cumsum(length) - length), length)
    return out[begin + np.arange(len(text))], text


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each of these hashes, in a map of ``2 ** BITS`` bits whatever their number; the driver reads at most one row per 64 bits."""
    place = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    bits = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))")).alias("bit")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[bits["at"].to_numpy()] = bits["bit"].to_numpy().view(np.uint64)
    return out


def on_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << BITS) - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
