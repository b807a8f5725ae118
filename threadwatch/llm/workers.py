"""What a reused Python worker keeps from one operator to the next.

Workers outlive stages.  What one operator remembers (lengths of pieces, powers of a base,
a loaded vocabulary) is of no use to the next, so a task says first what it is for, and the
first task of another kind lets go of the rest and gives the memory back.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

#: dicts that hold what workers remember
_KEPT: list[dict] = []
_purpose: list = []


def kept(memory: dict) -> dict:
    """Register a dict that may be emptied between purposes."""
    _KEPT.append(memory)
    return memory


def begin(*purpose) -> None:
    """Drop what tasks of another purpose left in this worker."""
    if _purpose == [purpose]:
        return
    if _purpose:
        for memory in _KEPT:
            memory.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim is not None:
            trim(0)
    _purpose[:] = [purpose]
