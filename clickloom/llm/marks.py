"""Bitmaps of bounded size that keep rows without a partner out of a later step."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import BITS, bitmap


class Marks:
    """A bitmap as a filter: keys that are in it, and a few others."""

    def __init__(self, bits: bytes):
        self.words = np.frombuffer(bits, np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        spot = keys & np.int64(len(self.words) * 8 - 1)
        return (self.words[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)

    def has(self, key: bytes) -> bool:
        return bool(self(np.frombuffer(key[:8], ">i8").astype(np.int64))[0])


def marks(keys: DataFrame, col: str):
    """A broadcast bitmap of a long column, 16 bits a key and 16 MB at most."""
    n, size = keys.count(), 1 << 20
    while size < 16 * n and size < 2 * BITS:
        size *= 2
    spots = keys.select(F.col(col).bitwiseAND(F.lit(size - 1)).alias("h"))
    return keys.sparkSession.sparkContext.broadcast(bitmap(spots, size))
