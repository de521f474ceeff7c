"""Sets of word shingles as sorted 64-bit values, vectorised over blocks of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import mix64, u64

#: Bytes between words: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_STEPS = [u64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Bytes hashed with one table of powers; longer words are hashed on their own.
_SPAN = 1 << 19
_LONG = 1 << 12


def _powers(q: int, n: int) -> np.ndarray:
    out = np.full(n, u64(q))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial over spans of bounded length."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)
    out = np.empty(len(starts), np.uint64)
    for k in np.flatnonzero(ends - starts > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(text[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + _SPAN - 1, side="right"))
        if to <= at:  # one long word
            at += 1
            continue
        s, e = starts[at:to] - base, ends[at:to] - base
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((text[base : base + e[-1]].astype(np.uint64) + u64(1)) * _UP[: e[-1]], out=sums[1:])
        own = mix64((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64) * u64(_BASE))
        short = e - s <= _LONG
        out[at:to][short] = own[short]
        at = to
    return out


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): each text's distinct shingles of `words` words, sorted, one text after the other.

    Letters A-Z count as a-z. A text of fewer words has one shingle, of all of them; one without words has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    text = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    flips = np.diff(np.concatenate(([True], _SPACE[text], [True])).view(np.int8))
    starts, ends = np.flatnonzero(flips == -1), np.flatnonzero(flips == 1)
    hashes = _word_hashes(text, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(texts))[: len(texts)]
    n = max(0, len(hashes) - words + 1)
    value = hashes[:n].copy()
    for k in range(1, words):
        value = (value ^ (value >> u64(29))) * _STEPS[(k - 1) % 3] + hashes[k : n + k]
    value = mix64(value)
    whole = doc[:n] == doc[words - 1 : n + words - 1] if n else np.zeros(0, bool)
    value, owner = value[whole], doc[:n][whole]
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        first = np.searchsorted(doc, few)
        extra = np.array([int.from_bytes(hashlib.blake2b(hashes[a : a + counts[d]].tobytes(), digest_size=8).digest(), "little") for a, d in zip(first, few)], np.uint64)
        value, owner = np.concatenate((value, extra)), np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(texts)), side="right")


def set_marks(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit mark of each set, the same for equal sets; an empty set has 0."""
    sums = np.concatenate(([u64(0)], np.cumsum(mix64(values * u64(_BASE) + u64(7)), dtype=np.uint64)))
    sizes = np.diff(np.concatenate(([0], ends))).astype(np.uint64)
    at = np.concatenate(([0], ends))
    return np.where(sizes > 0, mix64(sums[at[1:]] - sums[at[:-1]] + sizes * u64(0xA0761D6478BD642F)), u64(0))


def set_sketches(values: np.ndarray, ends: np.ndarray, bits: int = 512) -> np.ndarray:
    """Parity sketches, one row of bytes each: two sketches differ in no more bits than their sets differ in members."""
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    count = np.bincount(owner * bits + (values & u64(bits - 1)).astype(np.int64), minlength=len(ends) * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(ends), bits), axis=1)


def text_blocks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, one text at least."""
    at = total = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield at, k
            at, total = k, 0
        total += n + 1
    if at < len(texts):
        yield at, len(texts)
