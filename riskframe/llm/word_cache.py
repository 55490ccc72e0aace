"""Bounded caches of encoded words, kept by a Python worker from batch to batch."""

from __future__ import annotations

import gc
from collections.abc import Callable

LIMIT = 300_000


class Cache(dict):
    """word -> encoded bytes; a missing word is computed and stored, and a full cache is emptied by trim()."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        value = self[word] = self.compute(word)
        return value

    def trim(self) -> None:
        if len(self) > LIMIT:
            self.clear()


def quiet_collector() -> None:
    """Large caches of strings make collector passes long and find nothing; count references only."""
    gc.collect()
    gc.freeze()
    gc.disable()
