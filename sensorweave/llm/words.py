"""Word and shingle hashing shared by the operators that compare word sequences.

A word is a maximal run of code points other than the ASCII white space
U+0020 and U+0009..U+000D; ``bytes.split()`` cuts UTF-8 at exactly these.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Odd multipliers of the five-word shingle hash and its finaliser.
_MULTIPLIERS = (
    0x9E3779B97F4A7C15,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
    0xE7037ED1A0B428DB,
    0x8EBC6AF09C88C6E3,
    0x589965CC75374CC3,
)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` different words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased (other letters stay)."""
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_A
    h ^= h >> np.uint64(27)
    h *= _MIX_B
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up, self.down

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end) of ``data`` (numbers as unsigned 64-bit), wherever they stand."""
        up, down = self.upto(len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)], dtype=np.uint64)])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_POWERS = Powers(0x9E3779B97F4A7C15)


def quick_hashes(data: bytes, together: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, 64-bit hash) of every word; equal words have equal hashes, different ones can, too, if made for it.

    About ``together`` bytes are hashed at a time, so only the result grows with the text.
    """
    starts, hashes, at = [], [], 0
    while at < len(data):
        space = _SPACE.search(data, at + together)
        stop = space.start() if space else len(data)
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).view(np.int8))
        begin, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        starts.append(begin + at), hashes.append(_POWERS.hashes(raw.astype(np.uint64), begin, end))
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of ``k`` (at most 8) successive word hashes; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += hashes[i : i + n] * np.uint64(_MULTIPLIERS[i])
    return mixed(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingle hashes; with fewer words the whole sequence is one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < k:
        short = np.array(_MULTIPLIERS[: len(hashes)], np.uint64) ^ np.uint64(0xFF51AFD7ED558CCD)
        return mixed((hashes * short).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
    return np.unique(grams(hashes, k))
