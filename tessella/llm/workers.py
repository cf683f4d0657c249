"""Memory of Python workers, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def release() -> None:
    """Give memory that a task has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        return  # another C library
