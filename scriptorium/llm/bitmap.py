"""A bitmap of hashed values, made on the executors: what isn't in it isn't among the values. Its size is fixed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of 64-bit hashes in a bitmap of 2 ** bits places."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def build(rows: DataFrame, slot: str, bits: int) -> np.ndarray:
    """Bits of the places in a column; parts of the bitmap are made where the rows are."""
    s = rows.select((F.col(slot) + 1).alias("s"))
    parts = s.groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m"))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in parts.toLocalIterator():
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        out[(r["b"] - 1) * len(m) : r["b"] * len(m)] = m
    return out
