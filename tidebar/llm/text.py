"""Words, stable hashes and bounded caches that the text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

#: Unicode white space (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"

#: Runs between ASCII white space, the words of rules and shingles.
words = re.compile(r"[^\x20\x09-\x0D]+").findall


class Cache(dict):
    """Results of a function by key, for short keys and at most ``most`` of them.

    When half of that is reached, what is held becomes the older half; what is used again
    moves to the new one. It lives as long as the Python worker, so tasks that follow each
    other share it; when a task of another operator begins to fill its own, the others are emptied. A task
    fills one of them only.
    """

    every: list[Cache] = []
    filled: Cache | None = None

    def __init__(self, function: Callable, most: int = 800_000, longest: int = 48):
        self.function, self.half, self.longest, self.older = function, most // 2, longest, {}
        Cache.every.append(self)

    def __missing__(self, key):
        if Cache.filled is not self:
            Cache.filled = self
            for other in Cache.every:
                if other is not self:
                    other.clear()
                    other.older = {}
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = h >> np.uint64(31)
    x ^= h
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def unmixed(h: np.ndarray) -> np.ndarray:
    """The values that ``mixed`` has spread."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h = (h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))) * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


#: A word's hash is the polynomial of its bytes in ``_BASE``.
_BASE = 0xD1342543DE82EF95
_PIECE = 1 << 17


def _powers(base: int, size: int) -> np.ndarray:
    found = np.full(size, base, np.uint64)
    found[:1] = 1
    return np.multiply.accumulate(found)


_UP, _DOWN = _powers(_BASE, _PIECE), _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each of the ``words`` of all texts, in order, and the number of words of each text.

    Works on whole arrays: the bytes of a piece of text are summed up by word with powers that
    count from the start of the piece, and divided by the power at the start of the word.
    """
    wide = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[0] == ends[-1]:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = ~((data - np.uint8(9) < 5) | (data == 32))
    # No byte of a word counts as 0, white space does; UTF-8 has no byte 255.
    data = (data + np.uint8(1)) * inside
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        # Whole words, as many as a piece holds and one at least.
        to = len(starts)
        if len(data) - low > _PIECE:
            to = max(at + 1, int(np.searchsorted(starts, low + _PIECE, "right")) - 1)
        high = starts[to] if to < len(starts) else len(data)
        up = _UP if high - low <= _PIECE else _powers(_BASE, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(data[low:high] * up[: high - low], out=sums[1:])
        places = starts[at:to] - low
        sums = sums[np.append(places, high - low)]
        found[at:to] = (sums[1:] - sums[:-1]) * _DOWN[places]
        at = to
    return mixed(found), np.diff(np.searchsorted(starts, ends))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words, in order; none if there are fewer words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:size].copy()
    for k in range(1, n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + size]
    return mixed(total)


def lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    """A list column of consecutive stretches of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
