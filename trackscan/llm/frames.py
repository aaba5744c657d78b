"""Patched frame-of-reference blocks for arrays of unsigned 32-bit integers.

A block holds BLOCK values: the smallest value, a bit width, and the differences from the smallest
packed at that width. The width is the one that holds a share ``percentile`` of the block's
differences; the others are exceptions, kept with their whole difference beside their place.

Bytes of one block, little-endian:
    smallest u32 | width u8 | unused u8 | exceptions u16 | packed 4 * width * BLOCK / 32
    | places u8 each | differences u32 each
The last block is filled up with its smallest value. Work is for AT_ONCE values at a time, since its
steps take about ten times their memory.
"""

from __future__ import annotations

import numpy as np

BLOCK, HEAD = 256, 8
PERCENTILE = 0.9
AT_ONCE = 1024 * BLOCK


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes, and the offset of each block's start with the end as last item."""
    data, starts, end = [], [np.zeros(1, np.int64)], 0
    for a in range(0, len(values), AT_ONCE):
        some, at = _pack(values[a : a + AT_ONCE], percentile)
        data.append(some)
        starts.append(at[1:] + end)
        end += len(some)
    return b"".join(data), np.concatenate(starts)


def _pack(values: np.ndarray, percentile: float) -> tuple[bytes, np.ndarray]:
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = values
    padded[n:] = values[(blocks - 1) * BLOCK :].min()
    v = padded.reshape(blocks, BLOCK)
    least = v.min(axis=1)
    v = v - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bits(np.partition(v, at, axis=1)[:, at])
    over = (v >> np.minimum(width, 31)[:, None] > 0) & (width < 32)[:, None]
    exceptions = over.sum(axis=1)
    sizes = HEAD + width.astype(np.int64) * (BLOCK // 8) + 5 * exceptions
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((blocks, HEAD), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4] = width
    head[:, 6:] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[starts[:-1, None] + np.arange(HEAD)] = head
    for w in np.unique(width[width > 0]):
        those = np.flatnonzero(width == w)
        words = _pack_words(v[those].reshape(-1, 32), int(w))
        data = words.astype("<u4").view(np.uint8).reshape(len(those), -1)
        out[(starts[those] + HEAD)[:, None] + np.arange(data.shape[1])] = data
    row, place = np.nonzero(over)
    tail = starts[:-1] + HEAD + width.astype(np.int64) * (BLOCK // 8)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    out[tail[row] + rank] = place
    data = v[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail[row] + exceptions[row] + 4 * rank)[:, None] + np.arange(4)] = data
    return out.tobytes(), starts


def unpack(data: bytes | memoryview, starts: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks at starts (the last item is the end) in data."""
    raw, blocks, step = np.frombuffer(data, np.uint8), len(starts) - 1, AT_ONCE // BLOCK
    found = np.empty(blocks * BLOCK, np.uint32)
    for a in range(0, blocks, step):
        found[a * BLOCK : (a + step) * BLOCK] = _unpack(raw, starts[a : a + step + 1])
    return found[:n]


def _unpack(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    blocks = len(starts) - 1
    head = raw[starts[:-1, None] + np.arange(HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 6:]).view("<u2").ravel().astype(np.int64)
    v = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        those = np.flatnonzero(width == w)
        size = int(w) * (BLOCK // 8)
        words = raw[(starts[those] + HEAD)[:, None] + np.arange(size)].view("<u4")
        v[those] = _unpack_words(words.reshape(-1, int(w)), int(w)).reshape(-1, BLOCK)
    tail = starts[:-1] + HEAD + width * (BLOCK // 8)
    row = np.repeat(np.arange(blocks), exceptions)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    place = raw[tail[row] + rank]
    at = (tail[row] + exceptions[row] + 4 * rank)[:, None] + np.arange(4)
    v[row, place] = raw[at].view("<u4").ravel()
    return (v + least[:, None]).ravel()


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint32)


def _pack_words(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of 32 values as rows of w 32-bit words; bits above w are cut off."""
    v = v & np.uint32((1 << w) - 1)
    words = np.zeros((len(v), w + 1), np.uint32)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        words[:, word] |= v[:, i] << np.uint32(shift)
        if shift + w > 32:
            words[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return words[:, :w]


def _unpack_words(words: np.ndarray, w: int) -> np.ndarray:
    v = np.empty((len(words), 32), np.uint32)
    for i in range(32):
        word, shift = divmod(i * w, 32)
        v[:, i] = words[:, word] >> np.uint32(shift)
        if shift + w > 32:
            v[:, i] |= words[:, word + 1] << np.uint32(32 - shift)
    return v & np.uint32((1 << w) - 1)
