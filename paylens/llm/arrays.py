"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

A word's hash is a polynomial over its bytes, a shingle's a weighted sum of its
words' hashes; both end in a bit mixer. Everything is computed for some
megabytes of text at a time, so there is no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z, other letters as they are
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(count: int) -> np.ndarray:
    out = np.full(count, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Hashed:
    """Per text ``i``, the hashes ``values[offsets[i]:offsets[i + 1]]``."""

    values: np.ndarray
    offsets: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.offsets[:-1], self.offsets[1:]):
            yield self.values[a:b]


@dataclass
class Words(Hashed):
    """Word hashes; ``starts`` and ``ends`` are byte places inside ``data``."""

    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    text_offsets: np.ndarray


def slices(batch: pa.RecordBatch, column: str = "text",
           size: int = _SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each piece holds about ``size`` bytes of text."""
    texts = batch.column(column)
    sizes = np.diff(_offsets(texts.cast(pa.large_string()))[1])
    first = 0
    while first < batch.num_rows:
        count = int(np.searchsorted(np.cumsum(sizes[first:]), size)) + 1
        yield batch.slice(first, count)
        first += count


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and where each text begins; null is empty."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words of every text, without their hashes."""
    data, offsets = _offsets(texts.cast(pa.large_string()).fill_null(""))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = ~_SPACE[data]
    begins[1:] &= _SPACE[data[:-1]] | first[1:-1]
    return np.diff(np.searchsorted(np.flatnonzero(begins), offsets))


def words(texts: pa.Array) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z equal a-z."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    data, offsets = _offsets(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none,
                     data, offsets)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), counts, starts, ends, data, offsets)
    lengths = ends - starts
    place = np.flatnonzero(solid) - np.repeat(starts, lengths)
    terms = _BYTE[data[solid]] * _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return Words(mixed(sums + lengths.astype(np.uint64)), counts, starts, ends, data, offsets)


def shingles(found: Hashed, n: int, whole_if_short: bool = True) -> Hashed:
    """Hash of every run of ``n`` words, in order and with repeats.

    A text with fewer words counts as one shingle, or as none if not ``whole_if_short``.
    """
    values, offsets = found.values, found.offsets
    counts = np.diff(offsets)
    full = np.maximum(counts - n + 1, 0)
    total = max(len(values) - n + 1, 0)
    sums = np.zeros(total, np.uint64)
    for k in range(n):
        sums += values[k:k + total] * _PLACE[k]
    text = np.repeat(np.arange(len(counts)), counts)[:total]
    inside = np.arange(total) + n <= offsets[1:][text]
    made = mixed(sums[inside])
    if not whole_if_short:
        return Hashed(made, np.concatenate(([0], np.cumsum(full))))
    short = np.flatnonzero((counts > 0) & (counts < n))
    out_counts = full.copy()
    out_counts[short] = 1
    out_offsets = np.concatenate(([0], np.cumsum(out_counts)))
    out = np.empty(out_offsets[-1], np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[out_offsets[short]] = True
    out[~is_short] = made
    if len(short):
        alone = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            alone[has] += values[offsets[short[has]] + k] * _PLACE[k]
        out[is_short] = mixed(alone + counts[short].astype(np.uint64))
    return Hashed(out, out_offsets)
