"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_kept: list[tuple[Hashable, Any]] = []


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, kept for later tasks of this worker with the same key.

    Workers are reused by whatever stage comes next. One model is kept at a time, so that
    those of several operators, and their caches, never add up.
    """
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        returned()
        _kept.append((key, make()))
    return _kept[0][1]


def returned() -> None:
    """Give memory that isn't used any more back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
