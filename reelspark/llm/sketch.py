"""Fixed-size tables summed over all rows of a DataFrame: hashed counts and bitmaps.

Every task adds its rows into its own table and emits it in slices; slices with the same
number meet in one task, which adds them up as they stream by. The size is a parameter and
does not grow with the data; only the precision of what uses the table does. Callers use
them as filters or orders that stay right for any table content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import trimmed

SLICES = 64
SCHEMA = "slice int, cells binary"


def emit(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of a task's table that hold anything."""
    for i, part in enumerate(np.split(table, SLICES)):
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([i], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())})


def gather(parts: DataFrame, cells: int, dtype: str, add: Callable = np.add) -> np.ndarray:
    """The combined table on the driver (``cells`` entries: a fixed, small size)."""
    width = cells // SLICES

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                part = np.frombuffer(part.as_buffer(), dtype=dtype)
                if i in held:
                    add(held[i], part, out=held[i])
                else:
                    held[i] = part.copy()
        for i, part in held.items():
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array([i], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())})

    merged = parts.repartition(min(SLICES, 16), "slice").mapInArrow(trimmed(merge), SCHEMA)
    out = np.zeros(cells, dtype=dtype)
    for row in merged.collect():
        part = out[row["slice"] * width:(row["slice"] + 1) * width]
        add(part, np.frombuffer(row["cells"], dtype=dtype), out=part)
    return out


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits bits with the bit of each (64-bit, already hashed) value set."""
    cells = 1 << (bits - 3)

    def fill(batches):
        table = np.zeros(cells, dtype=np.uint8)
        for batch in batches:
            v = batch.column(column).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            at = v >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64),
                             np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        yield from emit(table)

    return gather(values.select(column).mapInArrow(trimmed(fill), SCHEMA), cells, "uint8", np.bitwise_or)


def holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set (never false for a value that was put in)."""
    bits = int(len(table)).bit_length() + 2
    at = values >> np.uint64(64 - bits)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
