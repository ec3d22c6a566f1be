"""A bit set of fixed size over 64-bit keys, built by Spark and small enough for every task.

Its size is a parameter (2 MB at 24 bits) whatever the number of keys; more keys
only let more rows through to the exact join that must follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG2_BITS = 24
_CHUNK = 32768  # bits of one bitmap row of Spark


def build(keys: DataFrame, column: str, log2_bits: int = LOG2_BITS) -> bytes:
    """Bit set of a column of well-mixed 64-bit keys, two bits each."""
    mask = F.lit((1 << log2_bits) - 1)
    bit = F.explode(
        F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 64 - log2_bits).bitwiseAND(mask))
    )
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.expr("bit div 32768").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits"))
        .collect()
    )
    out = bytearray((1 << log2_bits) // 8)
    for row in rows:
        out[row.chunk * _CHUNK // 8 : (row.chunk + 1) * _CHUNK // 8] = row.bits
    return bytes(out)


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each uint64 key may be in the set; bits as uint8."""
    log2_bits = int(len(bits) * 8).bit_length() - 1
    low = keys & np.uint64((1 << log2_bits) - 1)
    found = np.flatnonzero((bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
    high = keys[found] >> np.uint64(64 - log2_bits)
    out = np.zeros(len(keys), dtype=bool)
    out[found] = (bits[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8)) & 1
    return out
