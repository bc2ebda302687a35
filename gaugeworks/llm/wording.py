"""Words of texts as codes, in blocks of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of a long text that are split into words at once.
STRETCH = 1 << 20


def stretches(text: bytes, separator: re.Pattern[bytes], size: int = STRETCH) -> Iterator[bytes]:
    """A text in parts of about `size` bytes that end in a separator; longer only where one word is."""
    at = 0
    while len(text) - at > size:
        end = separator.search(text, at + size)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Tally:
    """Counts by key, summed within a task; put out whenever more than `held` keys are known."""

    def __init__(self, held: int = 1 << 21) -> None:
        self.held = held
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > self.held:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.concatenate([c for _, c in self.parts]))
            yield keys, counts
        self.parts, self.size = [], 0
