"""Bounded worker memory: small slices of Arrow batches, and memory given back at the end of each task.

Python workers are reused, so what one operator's tasks leave in the allocators' free lists would add to the next one's peak.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

SLICE_ROWS = 1024
_kept: dict[str, Callable[[], None]] = {}


def keep(name: str, clear: Callable[[], None]) -> None:
    """Announce what a worker keeps between tasks under a name, and how to drop it."""
    _kept[name] = clear


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows``, without copies."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def release() -> None:
    """Give free memory back to the system; where the C library has no such call, only Arrow's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def task(run: Callable, uses: str | None = None, rows: int = SLICE_ROWS) -> Callable:
    """A ``mapInArrow`` function over slices of at most ``rows`` that gives memory back at its end.

    Of what earlier tasks kept in this worker only ``uses`` stays: one operator's memory does not burden the next one's tasks.
    """

    @functools.wraps(run)
    def wrapped(batches):
        for name, clear in _kept.items():
            if name != uses:
                clear()
        try:
            yield from run(slices(batches, rows))
        finally:
            release()

    return wrapped
