"""What a Python worker process holds between tasks.

Spark uses a worker for the tasks of one operator after another, beside a heap that the executor has mostly filled by then. A worker therefore
has the tables of one operator at a time, and gives memory that a task has freed back to the system, which its allocators would keep.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The table of that key, made once and held until ``lean`` lets it go."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives freed memory back to the system, where the C library can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go(keeps: Hashable) -> None:
    """Lets all tables but that of the key ``keeps`` go. Tasks must call it: ``_held`` itself would travel with them as a copy."""
    others = [k for k in _held if k != keeps]
    for k in others:
        del _held[k]
    if others:
        release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Hashable = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow: before it starts all tables but that of the key ``keeps`` go, and what it frees is given back when it ends."""

    def task(batches):
        let_go(keeps)
        yield from run(batches)
        release()

    return task
