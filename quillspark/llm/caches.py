"""One operator's caches at a time in a worker process.

Spark reuses Python workers from stage to stage. An operator that starts in a worker claims
it, and what other operators cached there is freed.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


def claim(name: str) -> None:
    """From now on this worker works for ``name``."""
    if _owner[0] == name:
        return
    for other, clear in _clear.items():
        if other != name:
            clear()
    _owner[0] = name
    trim()


def trim() -> None:
    """Hand freed memory back."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library can
    if trim is not None:
        trim(0)
