"""Filters of fixed size that tell which hashes are worth sending to an exact join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bits of a hash filter: 512 KB, whatever it is built from
HASH_BITS = 22


def hash_filter(rows: DataFrame, column: str):
    """Broadcast bitmap over the low ``HASH_BITS`` bits of a column of 64-bit hashes.

    At most 2**HASH_BITS / 64 words reach the driver.
    """
    bit = F.col(column).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    words = rows.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b")) \
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas()
    bits = np.zeros((1 << HASH_BITS) // 64, np.int64)
    bits[words.w.to_numpy(np.int64)] = words.v.to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(bits.astype("<i8").tobytes())


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, np.uint8)
    at = (hashes & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most ``limit`` rows; a plain join side beyond."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
