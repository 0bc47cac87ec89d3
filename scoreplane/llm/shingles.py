"""Word shingles and MinHash signatures of whole texts, in numpy inside tasks."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

WORDS = 5
_PRIME = np.uint64(0x100000001B3)
_STEP = 1 << 22
_COLUMNS = 512


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words between ASCII white space; long texts go through in steps."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + _STEP)
        if b < len(data):  # end the step behind a word
            gap = np.flatnonzero((data[b:] == 32) | ((data[b:] >= 9) & (data[b:] <= 13)))
            b = b + int(gap[0]) if len(gap) else len(data)
        part = data[a:b]
        a = b
        inside = ~((part == 32) | ((part >= 9) & (part <= 13)))
        chars = part[inside].astype(np.uint64)
        if not len(chars):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        lengths = edge[1::2] - edge[::2]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        powers = np.cumprod(np.full(int(lengths.max()), _PRIME, np.uint64))
        place = np.arange(len(chars)) - np.repeat(starts, lengths)
        out.append(_mix(np.add.reduceat((chars + np.uint64(1)) * powers[place], starts)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of ``words`` words; a shorter text is one shingle, also the empty one."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(1, np.uint64)
    k = min(words, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return np.unique(_mix(total + np.uint64(k)))


def digest(values: np.ndarray) -> str:
    return hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest()


@lru_cache(maxsize=8)
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factor, rng.integers(0, 2**32, (count, 1), dtype=np.uint32)


def minhash(values: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """The low 16 bits of ``count`` MinHash values of a whole set, which goes through in short steps."""
    factor, shift = _permutations(count, seed)
    high = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(count, 2**32 - 1, np.uint32)
    for a in range(0, len(high), _COLUMNS):
        np.minimum(low, (high[a : a + _COLUMNS] * factor + shift).min(axis=1), out=low)
    return low.astype(np.uint16)
