"""Memory of Python workers, which Spark hands on from one operator to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa


def slim() -> None:
    """Gives freed memory back to the system: the allocators keep it otherwise, and so each operator's
    largest moment would stay with the worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def light(f: Callable) -> Callable:
    """f of one table or two, which gives back the memory of a group when it is done with it."""

    def one(t):
        out = f(t)
        slim()
        return out

    def two(t, other):
        out = f(t, other)
        slim()
        return out

    return one if f.__code__.co_argcount == 1 else two  # Spark looks at the number of arguments
