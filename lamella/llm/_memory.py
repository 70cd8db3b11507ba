"""Memory that a task has freed goes back to the system: Spark keeps its Python workers, and what an idle one holds counts against its executor."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from ._words import forget_powers


def give_back() -> None:
    """Return freed memory of Python, Arrow and the C library. Where the library can't trim, its part stays."""
    forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after whose last batch, when its tables are gone, the worker gives back what it freed."""

    @functools.wraps(run)
    def go(batches):
        give_back()  # what another operator's task has left
        try:
            yield from run(batches)
        finally:
            give_back()

    return go
