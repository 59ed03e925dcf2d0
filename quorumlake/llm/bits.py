"""Bit tables of bounded size: which hashes occur on one side of a join, so that the other side is thinned before a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = (16, 27)  # logarithm of a table's size, at least and at most (16 MB); where all bits are set, it drops nothing
EACH = 4096  # bits for each entry within these limits


def table_of(hashed: DataFrame, n: int) -> bytes:
    """A bit for each hash `h` (about n of them) that occurs."""
    size = min(max(LIMITS[0], (EACH * n).bit_length()), LIMITS[1])
    at = hashed.select(F.col("h").bitwiseAND((1 << size) - 1).alias("at"))
    rows = at.groupBy(F.expr("shiftright(at, 6)").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("word")).toArrow()
    out = np.zeros(1 << size - 6, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("word").to_numpy()
    return out.astype("<i8").tobytes()


def contained(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may occur; bits: the table's bytes."""
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
