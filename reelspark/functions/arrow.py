"""Helpers for the bodies of mapInArrow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Batches in which the rows of each value of an integer column come together, as tables that never split them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(name).to_numpy()
        others = np.flatnonzero(values != values[-1])
        last = int(others[-1]) + 1 if len(others) else 0        # the last value may go on
        begins = last > 0 or not held or held[-1].column(name)[-1].as_py() != values[-1]
        if begins:
            done = [*held, batch.slice(0, last)] if last else held
            if done:
                yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def trimmed(body: Callable) -> Callable:
    """A body of mapInArrow that gives back to the system what its task has freed: workers outlive their
    tasks, and else each stays as large as the largest task of any stage before made it."""
    def run(batches):
        try:
            yield from body(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc
            if trim:
                trim(0)
    return run
