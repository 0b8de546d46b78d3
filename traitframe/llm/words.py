"""Words of Arrow text columns as numpy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = (1 << 20) - 4096
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
LONG_RANGE = 256
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[str, np.ndarray] = {}
_LETTER, _MARK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = _MARK
_CLASS[[39, 60, 62, 124]] = 0  # apostrophes, and the signs that special tokens are made of


@dataclass
class Texts:
    """Some whole texts: row numbers in their batch, their bytes end to end, and where each begins."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray  # one more than rows

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts of a string column in chunks of about ``limit`` bytes; null reads as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Texts(np.arange(row, last), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def lower_case(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            power = np.empty(size, np.uint64)
            power[0], have, step = 1, 1, base & _MASK
            while have < size:  # doubling: the next half is the first times base**have
                power[have : 2 * have] = power[:have] * np.uint64(step)
                have, step = 2 * have, step * step & _MASK
            _tables[name] = power
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` for many ascending ranges, from one running sum per stretch of data.

    The sum is a polynomial modulo 2**64, in which long strings can be made to meet (a Thue-Morse word and its complement);
    so ranges of more than ``LONG_RANGE`` bytes have xxHash's value instead.
    """
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, low + CHUNK_BYTES, "right")))
        part = data[low : int(end[at:stop].max())]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        a, b = start[at:stop] - low, end[at:stop] - low
        out[at:stop] = mix((total[b] - total[a]) * down[a])
        at = stop
    for i in np.flatnonzero(end - start > LONG_RANGE):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def word_ranges(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of texts laid end to end; no word runs into the next text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_IS_SPACE[data]
    fresh = np.empty(len(data) + 1, bool)  # a word can't run over this place
    fresh[0] = fresh[-1] = True
    fresh[1:-1] = ~(solid[1:] & solid[:-1])
    fresh[starts[starts < len(data)]] = True
    return np.flatnonzero(fresh[:-1] & solid), np.flatnonzero(fresh[1:] & solid) + 1


def piece_ranges(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words, cut between ASCII letters and ASCII marks (apostrophes and ``<|>`` don't count as such)."""
    kind = _CLASS[data]
    cut = np.flatnonzero((kind[1:] ^ kind[:-1] == _LETTER | _MARK) & (kind[1:] != 0) & (kind[:-1] != 0)) + 1
    start, end = word_ranges(data, starts)
    if not len(cut):
        return start, end
    inner = np.searchsorted(start, cut, "right")  # only cuts inside a word; between texts there is one already
    cut = cut[(inner > 0) & (cut > start[inner - 1]) & (cut < end[inner - 1])]
    return np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))


@dataclass
class Words:
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray  # words of each text


def words_of(texts: Texts, lower: bool = True, pieces: bool = False) -> Words:
    """Hashes and ranges of all words, or of their pieces; A-Z as a-z if ``lower``."""
    data = lower_case(texts.data) if lower else texts.data
    start, end = (piece_ranges if pieces else word_ranges)(data, texts.starts)
    counts = np.diff(np.searchsorted(start, texts.starts))
    return Words(ranges_hash(data, start, end), start, end, counts)
