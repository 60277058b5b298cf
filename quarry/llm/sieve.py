"""A set of 64-bit values in a fixed number of bits, small enough to broadcast at any input size.

A value that was put in is always found. Others are found by chance, more of them the more
values there are; whoever uses a sieve drops them later by an exact join or comparison.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, power_of_two, shuffle_partitions


class Sieve:
    """Bits of hashes: the top bits of the hash give the slice, two more parts the bits in it."""

    def __init__(self, slices: int, bits: int):
        self.shift = np.uint64(64 - (slices.bit_length() - 1)) if slices > 1 else None
        self.bits = bits
        self.data = np.zeros((slices, bits // 8), np.uint8)

    def slice_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(hashes), np.int64)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(hashes)
        return (h % np.uint64(self.bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(self.bits)).astype(np.int64)

    def slice_bits(self, hashes: np.ndarray) -> bytes:
        on = np.zeros(self.bits, bool)
        for place in self.places(hashes):
            on[place] = True
        return np.packbits(on).tobytes()

    def passing(self, bits: bytes, hashes: np.ndarray) -> int:
        """How many of the hashes of one slice are found in its bits."""
        on = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        first, second = self.places(hashes)
        return int((on[first] & on[second]).sum())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        row = self.slice_of(hashes)
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.data[row, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 != 0
        return out


def sieve_of(ids: DataFrame, column: str, bits: int = 1 << 25) -> Sieve:
    """The sieve of a column of 64-bit integers; use ``has`` with ``mix`` of the values."""
    slices = power_of_two(shuffle_partitions(ids.sparkSession))
    out = Sieve(slices, max(1024, bits // slices))

    def merge(table: pa.Table) -> pa.Table:
        hashes = mix(table.column("id").to_numpy().astype(np.int64).view(np.uint64))
        row = int(out.slice_of(hashes[:1])[0])
        return pa.table({"slice": pa.array([row], pa.int32()), "bits": pa.array([out.slice_bits(hashes)], pa.binary())})

    def place(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out.slice_of(mix(values.view(np.uint64))), pa.int32()), pa.array(values)], names=["slice", "id"])

    placed = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").mapInArrow(place, "slice int, id long")
    for row in placed.groupBy("slice").applyInArrow(merge, "slice int, bits binary").toLocalIterator():
        out.data[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out
