"""Vectorised word and shingle hashing over UTF-8 bytes.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after lower-casing ``A-Z``.
A word's hash is a polynomial over its bytes modulo 2**64, finished by a bijective mixer; a shingle's
hash is a weighted sum of its words' hashes, finished the same way.  Whole documents are hashed; very long
ones are walked in blocks that end at white space, so scratch memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240501)
_BYTES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _SEED.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get("up")
    if have is None or len(have) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def word_hashes(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of lower-cased ``data`` (uint8)."""
    gap = space[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def lowered(data: bytes) -> np.ndarray:
    return _LOWER[np.frombuffer(data, np.uint8)]


def _pieces(data: np.ndarray, space: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            stops = np.flatnonzero(space[data[end : end + BLOCK]])
            if len(stops):
                end += int(stops[0])
                break
            end = min(end + BLOCK, len(data))
        yield data[at:end]
        at = end


def document_words(texts: list[bytes], space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of consecutive documents: (first, last + 1, word hashes, bounds); ``bounds[i]:bounds[i + 1]`` are those of
    document ``first + i``."""
    first = 0
    while first < len(texts):
        size, last = len(texts[first]), first + 1
        while last < len(texts) and size + len(texts[last]) <= BLOCK:
            size += len(texts[last]) + 1
            last += 1
        if last == first + 1 and size > BLOCK:
            words = np.concatenate([word_hashes(p, space)[0] for p in _pieces(lowered(texts[first]), space)])
            yield first, last, words, np.array([0, len(words)])
        else:
            data = lowered(b"\n".join(texts[first:last]))
            words, start = word_hashes(data, space)
            opens = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
            yield first, last, words, np.searchsorted(start, opens)
        first = last


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes; fewer words than ``WIDTH`` make one shingle."""
    if not len(words):
        return words
    if len(words) < WIDTH:
        short = (words * _PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return mix(np.array([short], np.uint64))
    n = len(words) - WIDTH + 1
    total = words[:n] * _PLACES[0]
    for j in range(1, WIDTH):
        total = total + words[j : n + j] * _PLACES[j]
    return np.unique(mix(total))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each document, in order."""
    for first, last, words, bounds in document_words(texts):
        for i in range(last - first):
            yield shingle_set(words[bounds[i] : bounds[i + 1]])
