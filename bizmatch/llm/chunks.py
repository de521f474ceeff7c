"""A bounded store of the ids of text chunks: each distinct chunk of a worker is encoded once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np


class _Numbers(dict):
    """chunk -> its number; a chunk that is new gets the next one and is noted in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n


class ChunkStore:
    """encode gives the ids of each of many chunks; flagged tells of a chunk that the caller has to handle itself.

    At more than `limit` chunks or `limit_chars` characters the store starts anew, so that its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list], flagged: Callable[[str], bool] | None = None, limit: int = 1_200_000, limit_chars: int = 24_000_000):
        self.encode, self.flagged, self.limit, self.limit_chars = encode, flagged, limit, limit_chars
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.chars = self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.odd = np.zeros(1 << 12, bool)
        self.ids = np.zeros(1 << 14, np.uint32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, len(a) * 3 // 2) - len(a), a.dtype)))

    def _add(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        n, base = len(self.numbers), len(self.numbers) - len(fresh)
        self.start, self.size, self.odd = self._room(self.start, n), self._room(self.size, n), self._room(self.odd, n)
        if self.flagged:
            self.odd[base:n] = [self.flagged(c) for c in fresh]
        found = self.encode(fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in found]) if isinstance(found[0], np.ndarray) else np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        self.ids = self._room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[base:n] = sizes
        self.start[base:n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.chars += sum(map(len, fresh))

    def look_up(self, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, given as its chunks, and whether one of them is flagged."""
        if len(self.numbers) > self.limit or self.chars > self.limit_chars:
            self.clear()
        number = self.numbers.__getitem__
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(number, chain.from_iterable(texts)), np.int64, int(lengths.sum()))
        self._add()
        size, start = self.size[at], self.start[at]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.concatenate(([0], ends))[bounds]
        odd = np.concatenate(([0], np.cumsum(self.odd[at])))[bounds]
        return [flat[cuts[k] : cuts[k + 1]] for k in range(len(texts))], odd[1:] > odd[:-1]
