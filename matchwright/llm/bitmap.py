"""A set of 64-bit keys as a bitmap of fixed size that tasks can ask.

A key sets two bits. The answer "not in the set" is always right; "in the set" may be
wrong, more often the fuller the map. Its size is a parameter and does not grow with the
set, so it may be sent to every task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """The bitmap of a column of longs, as bytes; 2 ** ``log_bits`` bits."""
    mask = (1 << log_bits) - 1
    places = F.array(F.shiftrightunsigned(column, 64 - log_bits), F.col(column).bitwiseAND(F.lit(mask)))
    bits = keys.select(F.explode(places).alias("p")).selectExpr("shiftright(p, 6) AS cell", "shiftleft(1L, cast(p & 63 AS int)) AS bit")
    found = bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[found.column("cell").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    log_bits = int(bits.size).bit_length() + 2
    a, b = keys >> np.uint64(64 - log_bits), keys & np.uint64((1 << log_bits) - 1)
    first = bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    second = bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    return (first & second).astype(bool)
