"""A hashed bit map of bounded size: a one-sided filter that is safe to ship to every task.

Its size is set by a row count and an upper bound in bits, never by the data's bytes; past the
bound it only lets more rows through, and the exact join behind it still decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64

MIN_BITS, MAX_BITS = 16, 28


class BitMap:
    """Bit ``mix64(key) >> (64 - bits)`` is set for every key added."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which unsigned 64-bit keys may have been added."""
        slot = mix64(keys) >> np.uint64(64 - self.bits)
        return (self.words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def _slots(bits: int):
    @F.pandas_udf("long")
    def slot(keys: pd.Series) -> pd.Series:
        return pd.Series((mix64(keys.to_numpy(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64))

    return slot


def build(df: DataFrame, key: Column, rows: int) -> BitMap:
    """Add ``key`` (long, not null) of every row; ``rows`` sizes the map, between 2**16 and 2**28 bits.

    The driver receives one pair for each 32-bit word that is not 0: at most 2**23 pairs.
    """
    bits = min(MAX_BITS, max(MIN_BITS, int(16 * max(rows, 1)).bit_length()))
    slot = _slots(bits)(key)
    found = (
        df.select(slot.alias("slot"))
        .groupBy(F.expr("slot >> 5").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 as int)))").alias("word"))
        .toPandas()
    )
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).astype(np.uint32)
    return BitMap(bits, words)
