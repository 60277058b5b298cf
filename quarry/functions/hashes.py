"""FNV-1a, the hash that decides a deterministic sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, PRIME = 14695981039346656037, 1099511628211  # fixed values of the 64-bit hash


#: Cells of the grid of bytes that are hashed side by side.
GRID = 1 << 24


def fnv1a(values: list[bytes]) -> np.ndarray:
    """Hashes of many byte strings at once, one byte position after another. Values are taken by
    length, as many at a time as a grid of bounded size holds."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    out = np.full(len(values), OFFSET, np.uint64)
    order = np.argsort(-lengths, kind="stable")
    begin = 0
    while begin < len(order) and (longest := int(lengths[order[begin]])):
        some = order[begin : begin + max(1, GRID // longest)]
        begin += len(some)
        wide = min(longest, GRID)
        h = out[some]
        for left in range(0, longest, wide):  # one value may be longer than the grid
            grid = np.zeros((len(some), min(wide, longest - left)), np.uint8)
            for row, i in enumerate(some):
                part = values[i][left : left + wide]
                grid[row, : len(part)] = np.frombuffer(part, np.uint8)
            active = np.searchsorted(-lengths[some], -np.arange(left, left + grid.shape[1]), side="left")
            for j in range(grid.shape[1]):
                n = active[j]
                h[:n] = (h[:n] ^ grid[:n, j]) * np.uint64(PRIME)
        out[some] = h
    return out


def fnv1a_mod(identity: Column, ts_ns: Column, rate: int) -> Column:
    """fnv1a(identity, then the time as 8 little-endian bytes) modulo ``rate``."""

    @F.pandas_udf("long")
    def run(text: pd.Series, ts: pd.Series) -> pd.Series:
        stamps = ts.to_numpy(np.int64).astype("<i8")
        return pd.Series((fnv1a([bytes(t) + s.tobytes() for t, s in zip(text, stamps, strict=True)]) % np.uint64(rate)).astype(np.int64))

    return run(identity, ts_ns)


def identity(tags: Column, fields: list[tuple[str, Column]]) -> Column:
    """Bytes of a record for sampling: key, zero, value, zero for each tag in key order and then
    for each present field."""
    zero = F.lit("\0")
    of_tags = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], zero, e["value"], zero)), "")
    of_fields = [F.coalesce(F.concat(F.lit(k), zero, text, zero), F.lit("")) for k, text in fields]
    return F.concat(of_tags, *of_fields).cast("binary")
