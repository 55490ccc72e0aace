"""Simple-8b: whole numbers packed into 64-bit words, coded and decoded in vectors.

A word holds a 4-bit selector (high bits) and 60 bits of values, the first value lowest. Selector 0 is an escape:
the following word is one raw value, of any size. Streams are cut into blocks of BLOCK values, and a table of word
offsets lets each block be decoded alone.

Stream layout, little-endian: b"S8B1", uint32 values, uint32 blocks, uint32 offsets[blocks + 1], uint64 words.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
MAGIC = b"S8B1"
# Fixed values of the format: (values per word, bits per value) by selector from 1.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
             (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([1, *[n for n, _ in SELECTORS]], np.int64)
WIDEST = 64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 64 for any that needs more than 60."""
    exponent = (values.astype(np.float64).view(np.int64) >> 52) - 1022
    exact = np.where(values >> np.uint64(52) > 0, WIDEST, np.maximum(exponent, 0))
    wide = np.flatnonzero(exact == WIDEST)
    exact[wide[values[wide] < np.uint64(1 << 60)]] = 60
    return exact.astype(np.uint8)


def _choices(widths: np.ndarray) -> np.ndarray:
    """Per position of each block (rows; padded with WIDEST) the selector of the word that would start there."""
    most = {1: widths}

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(x, WIDEST)
        out[:, :-by] = x[:, by:]
        return out

    for n, split in ((2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 4), (8, 4), (10, 5), (12, 6), (15, 8), (20, 10),
                     (30, 15), (60, 30), (120, 60)):
        most[n] = np.maximum(most[split], ahead(most[n - split], split))
    chosen = np.zeros_like(widths)
    for selector in range(len(SELECTORS), 0, -1):
        n, bits = SELECTORS[selector - 1]
        chosen[most[n] <= bits] = selector
    return chosen


def encode(values: np.ndarray) -> bytes:
    """The stream of an array of unsigned integers."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return struct.pack("<4sIII", MAGIC, 0, 0, 0)
    grid = np.zeros((blocks, BLOCK + 120), np.uint64)
    widths = np.full((blocks, BLOCK + 120), WIDEST, np.uint8)
    whole = len(values) // BLOCK
    for target, source in ((grid, values), (widths, _widths(values))):
        target[:whole, :BLOCK] = source[:whole * BLOCK].reshape(whole, BLOCK)
        target[whole:, :len(values) - whole * BLOCK] = source[whole * BLOCK:]
    chosen = _choices(widths)
    step = COUNTS[chosen.ravel()]
    stride = grid.shape[1]
    at = np.arange(blocks) * stride
    end = at + BLOCK
    end[-1] = at[-1] + len(values) - BLOCK * (blocks - 1)
    starts_word = np.zeros(grid.size, bool)
    while len(at):  # all blocks advance by one word together
        starts_word[at] = True
        at = at + step[at]
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    first = np.flatnonzero(starts_word)
    selector = chosen.ravel()[first]
    escaped = selector == 0
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(int(place[-1]) + 1 + int(escaped[-1]), np.uint64)
    flat = grid.ravel()
    for s in np.flatnonzero(np.bincount(selector)).tolist():
        mine = np.flatnonzero(selector == s)
        if not s:
            words[place[mine] + 1] = flat[first[mine]]
            continue
        n, bits = SELECTORS[s - 1]
        word = np.full(len(mine), s << 60, np.uint64)
        for i in range(n if bits else 0):
            word |= flat[first[mine] + i] << np.uint64(bits * i)
        words[place[mine]] = word
    offsets = np.append(place[np.searchsorted(first, np.arange(blocks) * stride)], len(words)).astype("<u4")
    return struct.pack("<4sII", MAGIC, len(values), blocks) + offsets.tobytes() + words.astype("<u8").tobytes()


def _expand(words: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    zero = np.flatnonzero(selector == 0)
    if len(zero):  # the word after an escape is raw, whatever its own bits say
        for run in np.split(zero, np.flatnonzero(np.diff(zero) != 1) + 1):
            raw[run[0] + 1:run[-1] + 2:2] = True
    head = np.flatnonzero(~raw)
    counts = COUNTS[selector[head]]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector[head]).tolist():
        mine = np.flatnonzero(selector[head] == s)
        if not s:
            out[start[mine]] = words[head[mine] + 1]
            continue
        n, bits = SELECTORS[s - 1]
        mask = np.uint64((1 << bits) - 1)
        for i in range(n if bits else 0):
            out[start[mine] + i] = (words[head[mine]] >> np.uint64(bits * i)) & mask
    return out


def decode(stream: bytes, blocks: range | None = None) -> np.ndarray:
    """The values of a stream, or of some of its blocks."""
    magic, _, number = struct.unpack_from("<4sII", stream)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b stream")
    offsets = np.frombuffer(stream, "<u4", number + 1, 12)
    words = np.frombuffer(stream, "<u8", int(offsets[-1]), 12 + 4 * (number + 1)).astype(np.uint64)
    if blocks is not None:
        if not len(blocks):
            return np.zeros(0, np.uint64)
        words = words[offsets[blocks[0]]:offsets[blocks[-1] + 1]]
    return _expand(words)
