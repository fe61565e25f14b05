"""Fixed-size bit filters over 64-bit keys, built by aggregation and broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BitFilter:
    """Tells which keys may be in a column. It has a set number of bits: a fuller one lets more keys pass, nothing else."""

    def __init__(self, keys: DataFrame, log2_bits: int, hashed: bool = False):
        """``hashed``: the keys are hashes already, so their low bits serve as the slot."""
        key, self.log2_bits = keys.columns[0], log2_bits
        slots = keys.select((F.col(key).bitwiseAND(F.lit((1 << log2_bits) - 1)) if hashed else self.slot(key)).alias("slot"))
        blocks = slots.select(F.floor(F.col("slot") / 32768).cast("int").alias("block"), (F.col("slot") % 32768).alias("bit"))
        bits = np.zeros((max(1, (1 << log2_bits) // 32768), 4096), np.uint8)
        for r in blocks.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
            bits[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def slot(self, column: str):
        """The bit of a key, as a column that ``hit`` takes."""
        return F.pmod(F.xxhash64(column), F.lit(1 << self.log2_bits))

    def hit(self, slots: np.ndarray) -> np.ndarray:
        return (self.shared.value[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)

    def hit_hashes(self, hashes: np.ndarray) -> np.ndarray:
        return self.hit((hashes & np.uint64((1 << self.log2_bits) - 1)).astype(np.int64))

    def hit_rows(self, slots: pa.Array) -> pa.Array:
        return pa.array(self.hit(slots.to_numpy(zero_copy_only=False).astype(np.int64)))
