"""Memory of Python workers: a worker lives on after its task, and so would the memory that the task has freed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc


def release() -> None:
    """Give freed memory back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, with its memory given back when it ends."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def portions(batch: pa.RecordBatch | pa.Array, texts: pa.Array, size: int = 1 << 20) -> Iterator:
    """Slices of ``batch`` whose texts, or lists, have about ``size`` bytes or entries; a longer one stands alone."""
    start, total = 0, 0
    lengths = pc.list_value_length(texts) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    for row, length in enumerate(lengths.to_pylist()):
        if row > start and total + (length or 0) > size:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += length or 0
    if start < len(texts):
        yield batch.slice(start)
