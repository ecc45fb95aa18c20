"""Memory of Python workers, which outlive their tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release() -> None:
    """Give memory that is no longer used back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def releasing(run):
    """The function over record batches, releasing memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
