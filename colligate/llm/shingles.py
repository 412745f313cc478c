"""Word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R)) | np.uint64(1)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]  # A-Z as a-z
_BYTES[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_cache: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if len(_cache.get(base, ())) < n:
        _cache[base] = _powers(base, max(n, 1 << 20))
    return _cache[base][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of a string array, and
    for each text where its words start (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = ~space[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    sums = np.add.reduceat(_BYTES[data] * _powers_of(_R, len(data)), at)
    return mix(sums * _powers_of(_INVERSE, len(data))[at]), np.searchsorted(at, offsets)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``width`` words of each text; of a shorter text
    its whole word sequence, of one without a word nothing."""
    words, starts = word_hashes(texts)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        grams += words[i : i + len(grams)] * odd[i]
    grams = mix(grams).view(np.int64)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * odd[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            out.append(mix(short).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
