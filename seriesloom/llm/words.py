"""Words of whole Arrow text columns as 64-bit hashes, by numpy over the UTF-8 bytes (no Python string per word).

A word is a longest run of bytes other than space and 09-0D, so byte-wise work equals the pattern [^\\x20\\x09-\\x0D]+.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Odd factors of the two lanes: of word hashes and of runs of words.
_WORD = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)
_GRAM = (0xD1342543DE82EF95, 0xE7037ED1A0B428DB)
#: Words of more bytes are hashed one by one.
_LONG = 512
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (pair[0], pair[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """ptr: of n texts, text i has the words ptr[i]:ptr[i+1]; start and end: bytes in data; hash and second: two
    independent 64-bit hashes of each word."""

    data: np.ndarray
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    second: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    size = 8 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else 4
    offsets = np.frombuffer(column.buffers()[1], dtype=f"i{size}", count=len(column) + 1, offset=column.offset * size).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2] if len(column) else None
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, np.zeros(len(offsets), np.int64), none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    word = ~_SEP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[offsets < n]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[offsets > 0] - 1
    last[edges] = word[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h, second = _word_hashes(_LOWER[data] if lower else data, start, end - start)
    return Words(data, np.searchsorted(start, offsets), start, end, h, second)


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes at a time go through a bijective mixing step, so no structure of a word (as with sums of powers)
    makes two words agree; each lane has its own factor."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    first, length = eight[start] & _MASK[np.minimum(size, 8)], size.astype(np.uint64)
    lanes = [mix(first + length * np.uint64(f)) for f in _WORD]
    at, rest = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(rest):
        more = eight[start[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
        for lane, f in zip(lanes, _WORD, strict=True):
            lane[rest] = mix(lane[rest] * np.uint64(f) ^ more)
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        digest = blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=16).digest()
        lanes[0][i], lanes[1][i] = np.frombuffer(digest, np.uint64)
    return lanes[0], lanes[1]


class Spans:
    """Hashes of any run of consecutive words in constant time each, from the words' hashes of one lane."""

    def __init__(self, h: np.ndarray, lane: int = 0):
        up, self.down = powers(_GRAM[lane], len(h))
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.down[start])


def gram_starts(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all k-grams that lie in one text, and the text of each."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[:-1], n), text
