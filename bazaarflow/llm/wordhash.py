"""Words of Arrow string columns as 64-bit hashes, without making Python strings.

A word is a run of bytes other than space and tab to carriage return; A-Z count as a-z. Two words have the same hash when
their bytes are the same; different ones share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER = (_LOWER + 1) * np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        longer = np.full(max(n, 2 * len(_powers)), _FACTOR, np.uint64)
        longer[0] = 1
        _powers = np.multiply.accumulate(longer)
    return _powers


@dataclass
class Words:
    """Words of some texts, one text after another."""

    first: int  # the number of the first text in the batch
    counts: np.ndarray  # words of each text
    hashes: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def text(self) -> np.ndarray:
        """The number, from 0, of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(texts: pa.Array, size: int = 1 << 20) -> Iterator[Words]:
    """The words of runs of texts of about ``size`` bytes; a longer text is alone. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        part = data[offsets[begin] : offsets[end]]
        starts = offsets[begin : end + 1] - offsets[begin]
        yield _hashed(begin, part, starts)
        begin = end


def _hashed(first: int, data: np.ndarray, bounds: np.ndarray) -> Words:
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    begins[inner] = solid[inner]
    at = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(at, bounds))
    if not len(at):
        return Words(first, counts, np.empty(0, np.uint64))
    place = np.flatnonzero(solid)
    start = np.searchsorted(place, at)
    length = np.diff(np.concatenate([start, [len(place)]]))
    inside = np.arange(len(place)) - np.repeat(start, length)
    value = _LOWER[data[place]] * powers(int(length.max()))[inside]
    return Words(first, counts, mix(np.add.reduceat(value, start) ^ length.astype(np.uint64)))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, in order."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out
