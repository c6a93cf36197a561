"""Word shingles of many texts at once, as 64-bit hashes, in numpy over bytes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from panelforge.llm.common import distinct

#: The bytes that separate words (space, tab to carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value for each byte (lower-casing A-Z), odd multipliers for places in a word, which bytes separate words."""
    rng = np.random.Generator(np.random.PCG64(7))
    value = rng.integers(0, 2**64, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    odd = rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    gap = np.zeros(256, bool)
    gap[list(SEPARATORS)] = True
    return value, odd, gap


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words of each text."""
    value, odd, gap = _tables()
    lens = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    word = ~gap[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(data), np.int64)
    stop = ~word
    stop[1:] &= word[:-1]
    stop[0] = False
    ends = np.flatnonzero(stop)
    size = ends - starts
    at = np.flatnonzero(word)
    place = at - np.repeat(starts, size)
    h = value[raw[at]] * odd[place & 1023]
    if size.max() > 1024:
        h *= (place.astype(np.uint64) >> np.uint64(10)) * np.uint64(2) + np.uint64(1)
    offs = np.cumsum(size) - size
    out = _mix(np.add.reduceat(h, offs) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)])))
    return out, counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words are one shingle, no words an empty set."""
    words, counts = word_hashes([(t or "").encode() for t in texts])
    if not len(words):
        return [np.zeros(0, np.uint64) for _ in texts]
    odd = _tables()[1]
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        rolled[: n - j] += words[j:] * odd[j]
    rolled = _mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(distinct(rolled[at : at + c - k + 1]))
        elif c:
            own = (words[at : at + c] * odd[:c]).sum(keepdims=True, dtype=np.uint64)
            out.append(_mix(own + odd[k : k + 1] * np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def set_digest(hashes: np.ndarray) -> int:
    """A 64-bit digest of a sorted set, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
