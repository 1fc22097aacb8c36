"""What operators with large blocks in Python workers share: long texts in pieces, and memory given back."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa

_SPACE = re.compile(rb"[ \t-\r]")  # ASCII white space: 0x20 and 0x09 to 0x0D


def cut(data: bytes, most: int) -> Iterator[bytes]:
    """Runs of at least ``most`` bytes, the last one as it comes, each but the last cut before white space; a longer word stays whole."""
    at = 0
    while len(data) - at > most:
        found = _SPACE.search(data, at + most)
        if found is None:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, several to a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
