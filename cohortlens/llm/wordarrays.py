"""Texts of an Arrow column as flat arrays: bytes, words, word hashes.

Work is done on slices of a batch of a few megabytes of text, so memory does not follow
the batch; one very long text is a slice of its own. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        grown = np.full(size, PRIME, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Text:
    """Bytes of some rows, where each row starts, and the first row's place in the batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Text]:
    if pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield Text(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start], start)
        start = stop


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    count: np.ndarray  # words of each row


def runs(text: Text, inside: np.ndarray) -> Words:
    """Maximal runs of marked bytes that do not cross rows."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, np.zeros(text.rows, dtype=np.int64))
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = text.offsets[:-1]
    before[edges[edges < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = text.offsets[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(text.offsets, start, side="right") - 1
    return Words(start, end, row, np.bincount(row, minlength=text.rows))


def spaced_words(text: Text) -> Words:
    """Runs of bytes other than a space and the five control characters from tab on."""
    data = text.data
    return runs(text, ~((data == 32) | ((data >= 9) & (data <= 13))))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte run; A-Z count as a-z if ``lower``."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    at = place + np.repeat(start, length)
    table = _BYTE[_LOWER] if lower else _BYTE
    terms = table[data[at]] * powers(int(length.max()))[place]
    return mix(np.add.reduceat(terms, first) + length.astype(np.uint64))


def windows(words: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside a row, and their first word."""
    n = len(h)
    if n < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k, power in enumerate(powers(size)):
        total += h[k : n - size + 1 + k] * power
    whole = words.row[: n - size + 1] == words.row[size - 1 :]
    at = np.flatnonzero(whole)
    return mix(total[at]), at
