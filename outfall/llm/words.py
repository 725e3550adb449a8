"""Vectorised words of many texts: positions, 64-bit hashes and windows, straight from the Arrow buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)
_NEWLINE, _NOTHING = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """Powers of the hash base, at least ``n`` of them."""
    global _power
    if len(_power) < n:
        steps = np.full(max(n, 2 * len(_power), 256), _STEP, np.uint64)
        steps[0] = 1
        _power = np.multiply.accumulate(steps)
    return _power


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer of all texts with a newline after each, and each text's start (one more: the end). Null: empty."""
    column = pc.binary_join_element_wise(pc.fill_null(column, "").cast(pa.large_string()), _NEWLINE, _NOTHING)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Word i covers bytes start[i]:end[i] of the buffer, belongs to text doc[i] and hashes to hash[i]."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text its first word; one more: the number of words


def spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each non-empty, non-overlapping, ascending span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sizes = end - start
    ends = np.cumsum(sizes)
    within = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    values = _BYTE[data[within + np.repeat(start, sizes)]] * powers(int(sizes.max()))[within]
    return mix(np.add.reduceat(values, ends - sizes) + sizes.astype(np.uint64))


def split_words(data: np.ndarray, starts: np.ndarray, lower: bool = False, piece: int = 1 << 20) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of joined texts; very long texts are hashed in pieces cut between words."""
    if lower:
        data = _LOWER[data]
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]
    hashes, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + piece)))
        hashes.append(spans_hashed(data, start[at:to], end[at:to]))
        at = to
    first = np.searchsorted(start, starts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    return Words(start, end, doc, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` words inside one text, and its first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[size - 1:])
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total = mix(total * _STEP + words.hash[at + i])
    return total, at


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of each text, ascending, flat, with their bounds. A shorter text is one window."""
    hashes, at = windows(words, size)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(size - 1):
            has = count[short] > i
            whole[has] = mix(whole[has] * _STEP + words.hash[words.first[short][has] + i])
        hashes, doc = np.concatenate((hashes, mix(whole + count[short].astype(np.uint64)))), np.concatenate((doc, short))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(count) + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between bounds."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind in "uf" else np.int64), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
