"""Words of many texts at once: where they are, and 64-bit hashes of them."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colligate.llm.shingles import mix

_R = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_R, -1, 1 << 64)
#: Bytes that are hashed at once; a longer word is hashed on its own.
BLOCK = 1 << 16
_UP = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, _R, np.uint64)])
_DOWN = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK, _INVERSE, np.uint64)])
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

INSIDE, BETWEEN, BREAK = 0, 1, 2


def kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte (A-Z lower-cased) is: inside a word, between words, or between pieces."""
    out = np.zeros(256, np.uint8)
    out[list(between)] = BETWEEN
    out[list(breaks)] = BREAK
    return out


class Words(NamedTuple):
    """The words of some texts: ``data`` are their bytes with A-Z lower-cased, ``at`` and ``end`` where each word
    is, ``hashes`` its hash, ``texts`` for each text where its words start (and one more), ``text`` each word's
    text, ``piece`` each word's piece, by numbers that grow."""

    data: np.ndarray
    at: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    texts: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes, each word followed by one space, and where each word starts (and one more)."""
        size = self.end - self.at
        starts = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=starts[1:])
        out = np.full(int(starts[-1]), 0x20, np.uint8)
        shift = np.repeat(self.at - starts[:-1], size)
        to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
        out[to] = self.data[to + shift]
        return out, starts


def words_of(texts: pa.Array, kind: np.ndarray) -> Words:
    """The words of a string array without nulls. ``kind`` is what ``kinds`` gives."""
    if texts.type != pa.string():
        texts = pc.cast(texts, pa.string())
    none = np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = offsets[-1] - offsets[0]
    if not size:
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), none, none)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    what = kind[data]
    inside = what == INSIDE
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][some], offsets[1:][some] - 1
    start[first], stop[last] = inside[first], inside[last]
    at, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    bounds = np.searchsorted(at, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    piece = text if not (kind == BREAK).any() else np.cumsum(what == BREAK, dtype=np.int64)[at] + text
    return Words(data, at, end, _hashes(data, at, end), bounds, text, piece)


def _hashes(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(at), np.uint64), 0
    while i < len(at):
        a = int(at[i])
        j = int(np.searchsorted(end, a + BLOCK, side="right"))
        if j <= i:
            j = i + 1
            out[i] = np.frombuffer(hashlib.blake2b(data[a : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
        else:
            own = slice(a, int(end[j - 1]))
            values = _BYTES[data[own]] * _UP[: own.stop - a]
            # what lies between words must not count
            sums = np.cumsum(values)
            before = np.where(at[i:j] > a, sums[at[i:j] - a - 1], np.uint64(0))
            out[i:j] = mix((sums[end[i:j] - a - 1] - before) * _DOWN[at[i:j] - a])
        i = j
    return out


def joined(packed: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings ``packed[start:end]`` as an Arrow array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    data = packed[np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
