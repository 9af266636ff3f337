"""Hashes of words and of word windows in whole batches of texts, in numpy.

Works on the bytes of an Arrow string array, a bounded number of bytes at a time. Words are runs of
bytes other than 0x20 and 0x09-0x0D, as in ``texts.WORD``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a single longer text is taken whole.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of each word. ``data``: bytes, in which texts are kept apart by a space."""
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word. ``data``: as for ``edges``."""
    space = _SPACE[data]
    start, end = edges(data)
    if not len(start):
        return np.empty(0, np.uint64), start
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    size = end - start
    place = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))[-len(data) + start[0] :] if start[0] == 0 else None
    if place is None:
        body = np.arange(start[0], len(data)) - np.repeat(start, np.diff(start, append=len(data)))
        place = np.concatenate([np.zeros(start[0], np.int64), body])
    place[space] = 0
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[place]
    terms[space] = 0
    return mix(np.add.reduceat(terms, start) + size.astype(np.uint64)), start


def parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, bounds): text first+k lies in bytes[bounds[k]:bounds[k+1] - 1], a space behind it. Null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, side="right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        n = last - first
        data = np.full(int(own[-1]) + n, 32, np.uint8)
        keep = np.ones(len(data), bool)
        keep[own[1:] + np.arange(n)] = False  # a space after each text
        data[keep] = raw[offsets[first] : offsets[last]]
        yield first, data, own + np.arange(n + 1)
        first = last


def chunks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, bounds): the words of text first+k are hashes[bounds[k]:bounds[k+1]]. Null texts have none."""
    for first, data, at in parts(texts):
        hashes, start = word_hashes(data, lower)
        yield first, hashes, np.searchsorted(start, at)


def double(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the concatenations of two adjacent windows."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, by doubling; shorter by length-1 than ``words``."""
    if length == 1:
        return words
    if length % 2:
        rest = windows(words, length - 1)
        return double(rest[:-1], words[length - 1 :]) if len(words) >= length else np.empty(0, np.uint64)
    half = windows(words, length // 2)
    n = len(words) - length + 1
    return double(half[:n], half[length // 2 :][:n]) if n > 0 else np.empty(0, np.uint64)
