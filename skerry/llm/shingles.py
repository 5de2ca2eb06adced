"""Sets of hashed word n-grams of many texts at once, by array operations on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def portions(texts: list[str], rows: int = 1000, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that together have few rows and characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (i - start == rows or size + len(t) > chars):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS = np.cumprod(np.concatenate([[1], np.full(255, 0x100000001B3)]).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the longest runs of a-z in the lower-cased texts, in order, and where each text's words begin (with the end)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 1)
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    letter = (buf >= 97) & (buf <= 122)
    edge = np.diff(letter.view(np.int8), prepend=0)
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    stop = np.flatnonzero(edge == -1)
    pos = np.flatnonzero(letter)
    length = stop - start
    inside = np.arange(len(pos)) - np.repeat(np.cumsum(length) - length, length)
    # Letters further than 255 into a run weigh by position again from 0, mixed with the round.
    part = buf[pos].astype(np.uint64) * _POWERS[inside & 255]
    if length.max() > 256:
        part = part * ((inside >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = np.add.reduceat(part, np.cumsum(length) - length)
    h = _mix(h + length.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    return h, np.searchsorted(start, np.concatenate([[0], ends]))


def shingle_sets(texts: list[str], n: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``n`` adjacent words, and where each text's begin (with the end); if not ``distinct``, all of them in order.

    A text of fewer than ``n`` words, but at least one, has one shingle of all its words; one without words has none.
    """
    h, at = word_hashes(texts)
    count = np.diff(at)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(texts)), size)
    first = np.arange(ends[-1]) - np.repeat(ends - size, size) + at[:-1][owner]
    g = np.zeros(len(first), np.uint64)
    limit = at[1:][owner]
    for j in range(n):
        there = first + j < limit
        g = np.where(there, _mix(g * np.uint64(3) + h[np.minimum(first + j, len(h) - 1)] + np.uint64(j + 1)), g)
    if not distinct:
        return g, np.concatenate([[0], ends])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(len(texts) + 1))
