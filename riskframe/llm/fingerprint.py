"""Word-shingle fingerprints of whole texts, computed batch-wise with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SEED = 42
LONG = 1024
LANES = np.uint64(0x0101010101010101)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane):
    return _turn(acc + lane * P2, 31) * P1


def _hash_equal_length(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """XXH64 with seed 42 of buffer[a:a + length] for every a in `at`."""
    def words(offset: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        view = np.ndarray((len(buffer) - size + 1,), kind, buffer, 0, (1,))
        return view[at + offset].astype(np.uint64)

    done, modulus, one, two = 0, 1 << 64, int(P1), int(P2)
    if length >= 32:
        lanes = [np.full(len(at), x % modulus, np.uint64) for x in (SEED + one + two, SEED + two, SEED, SEED - one)]
        while length - done >= 32:
            lanes = [_round(x, words(done + 8 * i, "<u8")) for i, x in enumerate(lanes)]
            done += 32
        out = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for x in lanes:
            out = (out ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        out = np.full(len(at), (SEED + int(P5)) % modulus, np.uint64)
    out = out + np.uint64(length)
    while length - done >= 8:
        out = _turn(out ^ _round(np.uint64(0), words(done, "<u8")), 27) * P1 + P4
        done += 8
    if length - done >= 4:
        out = _turn(out ^ (words(done, "<u4") * P1), 23) * P2 + P3
        done += 4
    while done < length:
        out = _turn(out ^ (words(done, "u1") * P5), 11) * P1
        done += 1
    out = (out ^ (out >> np.uint64(33))) * P2
    out = (out ^ (out >> np.uint64(29))) * P3
    return out ^ (out >> np.uint64(32))


def shingle_hashes(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every `size`-word shingle, repeats included, text by text, and the shingle offsets of the texts.

    A-Z is lower-cased, words are runs outside space and \\t to \\r, shingles are joined by one space. A text of
    fewer words has one shingle, all its words; a text without words has none.
    """
    texts = len(ends) - 1
    low = _LOWER[data]
    inside = ~_SPACE[low]
    before = np.empty(len(low), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = ends[:-1][ends[:-1] < len(low)]
    before[firsts] = False
    begins = inside & ~before
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    kept = np.flatnonzero(inside)
    word = (np.cumsum(begins) - 1)[kept]
    buffer = np.full(len(kept) + len(starts) + 8, 32, np.uint8)
    buffer[np.arange(len(kept)) + word] = low[kept]
    lengths = np.bincount(word, minlength=len(starts))
    tail = np.cumsum(lengths + 1) - 1
    head = tail - lengths
    per = np.diff(np.searchsorted(starts, ends))
    first_word = np.cumsum(per) - per
    count = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
    offsets = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(texts), count)
    begin = first_word[owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    last = begin + np.minimum(size, per[owner]) - 1
    at, length = head[begin], tail[last] - head[begin]
    out = np.empty(len(at), np.uint64)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        n = int(length[group[0]])
        if n > LONG:
            raw = buffer.tobytes()
            out[group] = [xxhash.xxh64_intdigest(raw[a:a + n], SEED) for a in at[group].tolist()]
        else:
            out[group] = _hash_equal_length(buffer, at[group], n)
    return out, offsets


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit word per text whose bit is 1 if it is set in over half the hashes of the text."""
    count = np.diff(offsets)
    texts = len(count)
    out = np.zeros(texts, np.uint64)
    if not len(hashes):
        return out
    # Byte lanes hold counts up to 255, so each text is summed in runs of 255 hashes.
    runs = -(-count // 255)
    run_ends = np.cumsum(runs)
    owner = np.repeat(np.arange(texts), runs)
    begin = offsets[:-1][owner] + 255 * (np.arange(run_ends[-1]) - (run_ends - runs)[owner])
    full = np.flatnonzero(count)
    first = (run_ends - runs)[full]
    half = count[full, None]
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte:byte + 1] > half)[:, 0].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def remix(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The turn-th independent 64-bit hash derived from a hash; turn 0 is the hash itself."""
    if not turn:
        return hashes
    x = hashes + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
