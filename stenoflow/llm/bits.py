"""A bounded bit filter over hashes: it lets Python drop, early, what a later join would not find, and never decides by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of a filter: about 16 for each entry, within these bounds (8 MB at most, whatever the data).
LEAST_BITS, MOST_BITS = 12, 26


def slots(entries: DataFrame, name: str = "h") -> np.ndarray:
    """One bit for each slot that the hash (a long column) of an entry falls into."""
    wanted = entries.agg(F.approx_count_distinct(name)).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted).bit_length()))
    place = entries.select(F.col(name).bitwiseAND(F.lit((1 << bits) - 1)).alias("p"))
    words = place.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in words:
        out[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return out


def hits(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes fall into a slot of the filter."""
    place = hashes & np.uint64(len(filter_) * 64 - 1)
    return ((filter_[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def hit(filter_: np.ndarray, value: int) -> bool:
    place = value & (len(filter_) * 64 - 1)
    return bool(int(filter_[place >> 6]) >> (place & 63) & 1)
