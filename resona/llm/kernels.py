"""Array kernels shared by the text operators: word bounds and 64-bit hashes over Arrow buffers.

Words are runs of bytes other than space and 0x09-0x0D in UTF-8, the same as the runs of
characters other than those, since UTF-8 uses these bytes for nothing else.  All kernels work on
slices of an Arrow batch that hold about ``CHUNK`` bytes of text (one text alone may be longer), so
a task's memory is bounded by its longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
M64 = (1 << 64) - 1


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` text bytes and at most ``rows`` rows each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 row bounds within them; a null is an empty row."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    bounds = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def letters_only(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, and every other ASCII byte that is no letter a space."""
    return _LETTERS[raw]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and, for each row, the n + 1 bounds of its words."""
    gap = np.ones(len(raw) + 1, dtype=bool)
    gap[:-1] = _SPACE[raw]
    first = ~gap[:-1]
    first[1:] &= gap[:-2]
    cut = bounds[1:-1]
    cut = cut[cut < len(raw)]
    first[cut] = ~gap[cut]
    last = ~gap[:-1]
    last[:-1] &= gap[1:-1]
    before = bounds[1:-1]
    before = before[before > 0] - 1
    last[before] = ~gap[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Powers:
    """Powers of an odd base mod 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        size = max(n, 2 * len(self.up), 1 << 12)
        self.up = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]).cumprod(dtype=np.uint64)
        self.down = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.inverse, np.uint64)]).cumprod(dtype=np.uint64)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of values[i] * base**(i - start) over each span."""
        if len(values) >= len(self.up):
            self.grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]


_BYTE_POWERS, _WORD_POWERS, _WORD_POWERS_2 = Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03), Powers(0xAEF17502108EF2D9)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums = _BYTE_POWERS.spans(_letters(seed)[raw], starts, ends)
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A hash of each run of words [start, end), given the words' hashes; second: independent of the first."""
    if second:
        return mix(_WORD_POWERS_2.spans(mix(words ^ np.uint64(0x5851F42D4C957F2D)), starts, ends) ^ np.uint64(0x14057B7EF767814F))
    return mix(_WORD_POWERS.spans(words, starts, ends))


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word starts there."""
    sizes = ends - starts
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + 1)])
    out = np.full(at[-1] + 8, 0x20, np.uint8)
    source = np.repeat(starts - at[:-1], sizes) if len(starts) else np.zeros(0, np.int64)
    inside = np.ones(at[-1], dtype=bool)
    inside[at[1:] - 1] = False
    place = np.flatnonzero(inside)
    out[place] = raw[place + source]
    return out, at


# XXH64's primes (fixed values)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _xxh64_block(raw: np.ndarray, lanes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of the ``size`` bytes at each position; lanes: the little-endian 8 bytes at every position."""
    n, p = len(at), 0
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        if size >= 32:
            v = [np.full(n, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while p + 32 <= size:
                v = [_round(v[i], lanes[at + (p + 8 * i)]) for i in range(4)]
                p += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
        else:
            h = np.full(n, s + _P5, np.uint64)
        h = h + np.uint64(size)
        while p + 8 <= size:
            h = _rotl(h ^ _round(np.uint64(0), lanes[at + p]), 27) * _P1 + _P4
            p += 8
        if p + 4 <= size:
            h = _rotl(h ^ ((lanes[at + p] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            p += 4
        while p < size:
            h = _rotl(h ^ (raw[at + p].astype(np.uint64) * _P5), 11) * _P1
            p += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of bytes; raw has 8 bytes more than the last end.  Spans of one size are hashed together."""
    import xxhash

    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lanes = np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(len(raw) - 7,), strides=(1,)))
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    whole = None
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]]), strict=True):
        at, size = order[lo:hi], int(ranked[lo])
        if hi - lo < 24 or size > 1024:
            whole = whole or raw.tobytes()
            out[at] = [xxhash.xxh64_intdigest(whole[s : s + size], seed) for s in starts[at].tolist()]
        else:
            out[at] = _xxh64_block(raw, lanes, starts[at], size, seed)
    return out


_LANES = np.array([sum(1 << (8 * i) for i in range(8) if x >> i & 1) for x in range(256)], np.uint64)


def bit_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row of values[bounds[i]:bounds[i + 1]], how many have each of the 64 bits set."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), 64), np.int64)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return out
    pieces = (sizes[rows] + 254) // 255  # eight counters of 8 bits in a word hold 255 values
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    at = np.repeat(bounds[rows], pieces) + 255 * within
    for byte in range(8):
        lanes = _LANES[(values >> np.uint64(8 * byte)).astype(np.uint8)]
        counts = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[rows, 8 * byte : 8 * byte + 8] = np.add.reduceat(counts, first, axis=0)
    return out
