"""Lossless WebP: a decoder of the whole format, and an encoder for rows of 8-bit samples.

The decoder reads prefix codes, back-references, the colour cache and several prefix-code groups,
and inverts the predictor, cross-colour, subtract-green and palette transforms.  Where a stream has
one group whose red, blue and alpha codes have a single symbol, and no cache, it finds the symbols
of all bit positions at once, copies included, and follows the chain of their sizes by doubling
jumps; else it goes pixel by pixel.  The encoder writes samples as green values: literals and
back-references, of what a predictor leaves where that is less, or of a palette of up to 16 values,
several to a pixel.  Images of one channel gain nothing by a colour cache or cross-colour.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Order in which code lengths of the code-length code are stored (fixed values).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Nearby offsets (x, y) of the first distance codes: by distance, then by |x|, the positive x first.
NEARBY = sorted(
    [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]),
)
LENGTH_CODES, DISTANCE_CODES, CACHE_FACTOR = 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
SEGMENT = 1 << 18
#: Extra bits of a length's or distance's prefix, and its least value.
EXTRA = np.array([0] * 4 + [(p - 2) >> 1 for p in range(4, DISTANCE_CODES)])
BASE = np.array([p + 1 for p in range(4)] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, DISTANCE_CODES)])
#: The encoder's copies: samples at least, at most, and how far back at most.
SHORTEST, LONGEST, WINDOW = 8, 4096, (1 << 15) - 120


class CorruptImage(ValueError):
    """The bytes are no lossless WebP image."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a prefix code of least total size, none above the limit; a lone symbol has length 1."""
    held = [s for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(held) == 1:
        lengths[held[0]] = 1
        return lengths
    flat = 0
    while True:
        heap = [(max(counts[s] >> flat, 1), s) for s in held]
        heapq.heapify(heap)
        parent, node = {}, len(counts)
        while len(heap) > 1:
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = node
            heapq.heapreplace(heap, (a + b, node))
            node += 1
        depth = {node - 1: 0}
        for inner in range(node - 2, len(counts) - 1, -1):
            depth[inner] = depth[parent[inner]] + 1
        for s in held:
            lengths[s] = depth[parent[s]] + 1
        if max(lengths) <= limit:
            return lengths
        flat += 1


_REVERSED = [0]
for _bit in range(14, -1, -1):
    _REVERSED += [x | 1 << _bit for x in _REVERSED]


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, length)."""
    code, out, before = 0, {}, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - before
        before = length
        out[symbol] = (_REVERSED[code] >> (15 - length), length)
        code += 1
    return out


@dataclass
class Code:
    """A prefix code as a table over the next ``bits`` bits, of symbol * 16 + length."""

    bits: int
    table: np.ndarray

    @classmethod
    def of(cls, lengths: list[int]) -> Code:
        held = [s for s, n in enumerate(lengths) if n]
        if len(held) == 1:
            return cls(0, np.array([held[0] << 4], np.int32))
        bits = max(lengths, default=0)
        if not held or sum(1 << (bits - n) for n in lengths if n) != 1 << bits:
            raise CorruptImage("a prefix code is not complete")
        table = np.zeros(1 << bits, np.int32)
        for symbol, (code, length) in canonical(lengths).items():
            table[code :: 1 << length] = symbol << 4 | length
        return cls(bits, table)

    @property
    def single(self) -> int | None:
        return int(self.table[0]) >> 4 if self.bits == 0 else None


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.count < n:
            block = self.data[self.at : self.at + 8]
            self.at += 8
            self.held |= int.from_bytes(block, "little") << self.count
            self.count += 64
            if self.at > len(self.data) + 64:
                raise CorruptImage("the image ends early")

    def read(self, n: int) -> int:
        self._fill(n)
        value = self.held & ((1 << n) - 1)
        self.held >>= n
        self.count -= n
        return value

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return int(code.table[0]) >> 4
        self._fill(code.bits)
        entry = int(code.table[self.held & ((1 << code.bits) - 1)])
        n = entry & 15
        self.held >>= n
        self.count -= n
        return entry >> 4

    @property
    def position(self) -> int:
        return 8 * self.at - self.count

    def seek(self, position: int) -> None:
        self.at, self.held, self.count = position // 8, 0, 0
        self.read(position % 8)


# --------------------------------------------------------------------- decoder


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= alphabet:
                raise CorruptImage("a symbol is out of range")
            lengths[s] = 1
        return Code.of(lengths)
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[i]] = bits.read(3)
    code = Code.of(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, n = {16: (before, 3), 17: (0, 3), 18: (0, 11)}[s]
        n += bits.read({16: 2, 17: 3, 18: 7}[s])
        if at + n > alphabet:
            raise CorruptImage("a run of code lengths is too long")
        lengths[at : at + n] = [value] * n
        at += n
    return Code.of(lengths)


def _value(bits: Bits, prefix: int) -> int:
    return int(BASE[prefix]) + bits.read(int(EXTRA[prefix]))


@lru_cache(maxsize=32)
def _near(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distances of the nearby codes at this width, and the code of each distance they reach."""
    distances = np.array([0] + [max(1, dx + dy * width) for dx, dy in NEARBY])
    codes = np.arange(8 * width + 9) + len(NEARBY)
    for code in range(len(NEARBY), 0, -1):
        codes[distances[code]] = code
    return distances, codes


def _samples(bits: Bits, green: Code, distance: Code, n: int, width: int) -> np.ndarray:
    """The next n values of an image in which only green varies: literals, and copies of earlier ones."""
    start = bits.position
    raw = np.zeros(len(bits.data) - start // 8 + 24, np.uint32)
    raw[:-24] = np.frombuffer(bits.data, np.uint8)[start // 8 :]
    table, copies = green.table.astype(np.int16), bool(green.table.max() >> 4 >= 256)
    longest, shift = green.bits + (43 if copies else 0), np.arange(8, dtype=np.uint32)
    mask, distance_mask = np.uint32((1 << green.bits) - 1), (1 << distance.bits) - 1
    symbols, lengths, distances = [], [], []
    done, local, base = 0, start % 8, 0
    while done < n:
        span = min(SEGMENT, 8 * (len(raw) - 24 - base))
        if span <= local:
            raise CorruptImage("the image ends early")
        span = min(span, -(-(local + (n - done) * longest) // 8) * 8)
        part = raw[base : base + span // 8 + 16]
        wide = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        entry = table.take((wide[: span // 8, None] >> shift & mask).reshape(-1))
        # from span on, a position leads to itself
        jump = np.arange(span + 64, dtype=np.int32)
        jump[:span] += entry & 15
        peek = lambda at, w=wide: w[at >> 3] >> (at & 7).astype(np.uint32)
        if copies:
            at = np.flatnonzero(entry >= 256 << 4)
            then = jump[at] + EXTRA[(entry[at] >> 4) - 256]
            found = distance.table[peek(then) & distance_mask]
            jump[at] = then + (found & 15) + EXTRA[found >> 4]
        jumps = [jump]
        for _ in range(3):
            jumps.append(jumps[-1].take(jumps[-1]))
        at, seen, far = local, [], memoryview(jumps.pop())
        while at < span:
            seen.append(at)
            at = far[at]
        at_all = np.array(seen, np.int32)
        for j in reversed(jumps):
            at_all = np.stack([at_all, j.take(at_all)], axis=1).reshape(-1)
        at_all = at_all[at_all < span][: n - done]
        symbol = entry[at_all] >> 4
        size = np.ones(len(at_all), np.int64)
        if copies:
            which = np.flatnonzero(symbol >= 256)
            at, kind = at_all[which] + (entry[at_all[which]] & 15), symbol[which] - 256
            size[which] = BASE[kind] + (peek(at) & (1 << EXTRA[kind]) - 1)
            at = at + EXTRA[kind]
            found = distance.table[peek(at) & distance_mask]
            away = BASE[found >> 4] + (peek(at + (found & 15)) & (1 << EXTRA[found >> 4]) - 1)
            whole = int(np.searchsorted(np.cumsum(size), n - done)) + 1
            at_all, symbol, size, away = at_all[:whole], symbol[:whole], size[:whole], away[which < whole]
            near = _near(width)[0]
            distances.append(np.where(away > len(NEARBY), away - len(NEARBY), near[np.minimum(away, len(NEARBY))]))
        symbols.append(symbol)
        lengths.append(size)
        done += int(size.sum())
        last = int(jump[at_all[-1]])
        base, local = base + last // 8, last % 8
    if done > n or 8 * base + local > 8 * (len(raw) - 24):
        raise CorruptImage("the image ends early")
    bits.seek(start // 8 * 8 + 8 * base + local)
    if not copies:
        return np.concatenate(symbols).astype(np.uint32)
    symbol, size = np.concatenate(symbols), np.concatenate(lengths)
    begin, out = np.cumsum(size) - size, np.zeros(n, np.uint8)
    literal = symbol < 256
    out[begin[literal]] = symbol[literal]
    held = bytearray(out)
    for at, k, d in zip(begin[~literal].tolist(), size[~literal].tolist(), np.concatenate(distances).tolist(), strict=True):
        if d > at:
            raise CorruptImage("a back-reference leaves the image")
        held[at : at + k] = held[at - d : at - d + k] if d >= k else (held[at - d : at] * (k // d + 1))[:k]
    return np.frombuffer(held, np.uint8).astype(np.uint32)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The ARGB values, row after row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise CorruptImage("the colour cache is too large")
    group_bits, group_of, groups = 0, None, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = -(-width // (1 << group_bits))
        group_of = _entropy_image(bits, across, -(-height // (1 << group_bits)), False).astype(np.int64) >> 8 & 0xFFFF
        groups = int(group_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache_size and all(c.single is not None for c in codes[0][1:4]):
        rest = codes[0][3].single << 24 | codes[0][1].single << 16 | codes[0][2].single
        if codes[0][0].bits == 0 and codes[0][0].single < 256:
            return np.full(n, rest | codes[0][0].single << 8, np.uint32)
        if codes[0][0].bits:
            return _samples(bits, codes[0][0], codes[0][4], n, width) << np.uint32(8) | np.uint32(rest)
    out, cache, at = [0] * n, [0] * cache_size, 0
    shift = 32 - cache_bits
    while at < n:
        if group_of is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, distance = codes[int(group_of[(y >> group_bits) * across + (x >> group_bits)])]
        else:
            green, red, blue, alpha, distance = codes[0]
        s = bits.symbol(green)
        if s < 256:
            r, b = bits.symbol(red), bits.symbol(blue)
            out[at] = bits.symbol(alpha) << 24 | r << 16 | s << 8 | b
            first, at = at, at + 1
        elif s < 256 + LENGTH_CODES:
            length = _value(bits, s - 256)
            d = _value(bits, bits.symbol(distance))
            if d > len(NEARBY):
                d -= len(NEARBY)
            else:
                dx, dy = NEARBY[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > n:
                raise CorruptImage("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - d]
            first, at = at, at + length
        else:
            out[at] = cache[s - 256 - LENGTH_CODES]
            first, at = at, at + 1
        if cache_size:
            for i in range(first, at):
                cache[(CACHE_FACTOR * out[i] & 0xFFFFFFFF) >> shift] = out[i]
    return np.array(out, np.int64)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) with alpha, red, green and blue."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = channels & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predicted channels from the neighbours at the left, above, above right and above left."""
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    mean = lambda p, q: [(a + b) >> 1 for a, b in zip(p, q, strict=True)]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clamp = lambda x: min(max(x, 0), 255)
    if mode == 12:
        return [clamp(a + t - c) for a, t, c in zip(left, top, corner, strict=True)]
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]


def _undo_predictor(pixels: np.ndarray, width: int, height: int, size: int, modes: np.ndarray) -> np.ndarray:
    if set((modes >> 8 & 15).tolist()) in ({1}, {2}):
        # one mode all over: sums along the edge that it starts from, then from there
        rows = _channels(pixels).reshape(height, width, 4)
        rows[0, 0] += (255, 0, 0, 0)
        first, then = (0, 1) if modes[0] >> 8 & 15 == 1 else (1, 0)
        edge = rows[:, 0] if first == 0 else rows[0]
        edge[:] = np.cumsum(edge, axis=0)
        return _pixels(np.cumsum(rows, axis=then)).reshape(-1)
    rows, across = _channels(pixels).tolist(), -(-width // (1 << size))
    for i in range(width * height):
        y, x = divmod(i, width)
        if not i:
            guess = [255, 0, 0, 0]
        elif not y:
            guess = rows[i - 1]
        elif not x:
            guess = rows[i - width]
        else:
            mode = int(modes[(y >> size) * across + (x >> size)]) >> 8 & 15
            guess = _predict(mode, rows[i - 1], rows[i - width], rows[i - width + 1], rows[i - width - 1])
        rows[i] = [(a + b) & 255 for a, b in zip(rows[i], guess, strict=True)]
    return _pixels(np.array(rows, np.int64))


def _undo_cross_colour(pixels: np.ndarray, width: int, height: int, size: int, elements: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    element = _channels(elements[(y >> size) * -(-width // (1 << size)) + (x >> size)])
    signed = lambda v: (v & 0xFF) - ((v & 0x80) << 1)
    delta = lambda t, c: signed(t) * signed(c) >> 5
    c = _channels(pixels)
    c[:, 1] = c[:, 1] + delta(element[:, 3], c[:, 2]) & 0xFF
    c[:, 3] = c[:, 3] + delta(element[:, 2], c[:, 2]) + delta(element[:, 1], c[:, 1]) & 0xFF
    return _pixels(c)


def _undo_palette(pixels: np.ndarray, width: int, height: int, bundle: int, palette: np.ndarray) -> np.ndarray:
    index = pixels >> 8 & 0xFF
    if bundle:
        depth = 8 >> bundle
        packed = index.reshape(height, -1)
        index = (packed[:, :, None] >> (depth * np.arange(1 << bundle)) & ((1 << depth) - 1)).reshape(height, -1)[:, :width].reshape(-1)
    colours = np.concatenate([palette, np.zeros(256 - len(palette), np.int64)])
    return colours[index]


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The image as a (height, width) array of ARGB values."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise CorruptImage("no lossless WebP")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise CorruptImage("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise CorruptImage("the version is unknown")
    steps, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            blocks = _entropy_image(bits, -(-across // (1 << size)), -(-height // (1 << size)), False).astype(np.int64)
            undo = _undo_predictor if kind == PREDICTOR else _undo_cross_colour
            steps.append(lambda p, w=across, s=size, b=blocks, f=undo: f(p, w, height, s, b))
        elif kind == SUBTRACT_GREEN:
            steps.append(lambda p: p & 0xFF00FF00 | (p & 0xFF00FF) + (p >> 8 & 0xFF) * 0x10001 & 0xFF00FF)
        else:
            count = bits.read(8) + 1
            palette = _pixels(np.cumsum(_channels(_entropy_image(bits, count, 1, False).astype(np.int64)), axis=0))
            steps.append(lambda p, w=across, b=_bundle(count), c=palette: _undo_palette(p, w, height, b, c))
            across = -(-across // (1 << _bundle(count)))
    pixels = _entropy_image(bits, across, height, True)
    for undo in reversed(steps):
        pixels = undo(pixels.astype(np.int64))
    return pixels.reshape(height, width)


# --------------------------------------------------------------------- encoder


@dataclass
class Writer:
    """Bits, the lowest of each byte first."""

    value: int = 0
    count: int = 0
    done: list[bytes] = field(default_factory=list)

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Each value in so many bits, 15 at most."""
        ends = np.cumsum(sizes) + self.count
        total = int(ends[-1]) if len(ends) else self.count
        starts = ends - sizes
        moved, at, n = values << (starts & 7), starts >> 3, total // 8 + 4
        # no two values share a bit, so sums of their bytes are their unions
        out = sum(np.bincount(at + k, moved >> (8 * k) & 0xFF, n) for k in range(3)).astype(np.int64)
        for k, byte in enumerate(self.value.to_bytes(-(-self.count // 8), "little")):
            out[k] |= byte
        whole = total // 8
        self.done.append(out[:whole].astype(np.uint8).tobytes())
        self.value, self.count = int(out[whole]) if total % 8 else 0, total % 8

    def data(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes(-(-self.count // 8), "little")


def write_lone(to: Writer, symbol: int) -> None:
    """A prefix code of one symbol below 256."""
    to.put(1 | 1 << 2 | symbol << 3, 11)


def write_code(to: Writer, lengths: list[int]) -> None:
    """A prefix code's lengths, as the decoder reads them."""
    held = [s for s, n in enumerate(lengths) if n]
    if len(held) <= 2 and max(held, default=0) < 256:
        held = held or [0]
        to.put(1 | (len(held) - 1) << 1 | 1 << 2, 3)
        for s in held:
            to.put(s, 8)
        return
    tokens = []
    for value, same in groupby(lengths):
        run = len(list(same))
        if value and run:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            n = min(run, 6 if value else 138)
            tokens.append((16, n - 3, 2) if value else (17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            run -= n
        tokens += [(value, 0, 0)] * run
    counts = [0] * 19
    for s, _, _ in tokens:
        counts[s] += 1
    of_lengths = code_lengths(counts, 7)
    codes = canonical(of_lengths)
    stored = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if of_lengths[s]))
    to.put(0 | (stored - 4) << 1, 5)
    for i in range(stored):
        to.put(of_lengths[LENGTH_ORDER[i]], 3)
    to.put(0, 1)
    alone = sum(n > 0 for n in of_lengths) == 1
    value = count = 0
    for s, extra, n in tokens:
        if not alone:
            code, size = codes[s]
            value |= code << count
            count += size
        value |= extra << count
        count += n
    to.put(value, count)


def _entropy(counts: np.ndarray) -> float:
    """Bits a sample."""
    n = counts[counts > 0]
    total = n.sum()
    return float(np.log2(total) - n @ np.log2(n) / total) if len(n) else 0.0


def _copies(samples: np.ndarray, each: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of stretches that occurred before, where a copy takes fewer bits than the samples."""
    none = np.zeros(0, np.int64)
    if len(samples) <= SHORTEST:
        return none, none, none
    two = samples[:-1].astype(np.uint64) | samples[1:].astype(np.uint64) << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    order = np.argsort(eight, kind="stable")
    again = np.flatnonzero(eight[order[1:]] == eight[order[:-1]])
    back = np.zeros(len(eight) + 1, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    back[back > WINDOW] = 0
    # where the distance stays, eight samples that occurred before go on in the next eight
    turns = np.flatnonzero(back[1:] != back[:-1]) + 1  # the first has no distance
    found, at = [], 0
    for first, last, d in zip(turns[:-1].tolist(), turns[1:].tolist(), back[turns[:-1]].tolist(), strict=True):
        first, last = max(first, at), last + SHORTEST - 1
        # a copy is a length symbol, a distance symbol and their extra bits
        if d and last - first >= SHORTEST and (last - first) * each > 10 + d.bit_length() + (last - first).bit_length():
            found += [(i, min(LONGEST, last - i), d) for i in range(first, last, LONGEST)]
            at = last
    return tuple(np.array(found, np.int64).T) if found else (none, none, none)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix of each value, its extra bits and their number."""
    prefix = np.searchsorted(BASE, values, side="right") - 1
    return prefix, values - BASE[prefix], EXTRA[prefix]


def _coded(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number by symbol; a lone symbol takes none."""
    value, size = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    codes = canonical(lengths)
    for s, (code, n) in codes.items() if len(codes) > 1 else ():
        value[s], size[s] = code, n
    return value, size


def _write_samples(to: Writer, samples: np.ndarray, width: int, alpha: int = 255) -> None:
    """Samples as green values: literals, and copies of what came before."""
    counts = np.bincount(samples, minlength=256 + LENGTH_CODES)
    start, length, back = _copies(samples, _entropy(counts)) if np.count_nonzero(counts) > 1 else [np.zeros(0, np.int64)] * 3
    edges = np.zeros(len(samples) + 1, np.int64)
    edges[start] = 1
    edges[start + length] -= 1
    literal = np.cumsum(edges[:-1]) == 0
    near = _near(width)[1]
    code = np.where(back < len(near), near[np.minimum(back, len(near) - 1)], back + len(NEARBY))
    (kind, more, more_bits), (far, rest, rest_bits) = _prefixed(length), _prefixed(code)
    counts = np.bincount(np.concatenate([samples[literal], kind + 256]), minlength=256 + LENGTH_CODES)
    lengths = code_lengths(counts.tolist(), 15)
    distances = code_lengths(np.bincount(far, minlength=DISTANCE_CODES).tolist(), 15) if len(far) else [1]
    write_code(to, lengths)
    for symbol in (0, 0, alpha):
        write_lone(to, symbol)
    write_code(to, distances)
    (value, size), (far_value, far_size) = _coded(lengths), _coded(distances)
    if not len(start):
        if np.count_nonzero(counts) > 1:
            to.put_all(value[samples], size[samples])
        return
    places = literal.astype(np.int64)
    places[start] = 4
    places = np.cumsum(places) - places
    values, sizes = np.zeros((2, np.count_nonzero(literal) + 4 * len(start)), np.int64)
    values[places[literal]], sizes[places[literal]] = value[samples[literal]], size[samples[literal]]
    parts = (value[kind + 256], size[kind + 256]), (more, more_bits), (far_value[far], far_size[far]), (rest, rest_bits)
    for k, (v, n) in enumerate(parts):
        values[places[start] + k], sizes[places[start] + k] = v, n
    to.put_all(values, sizes)


def _predicted(samples: np.ndarray) -> tuple[int, np.ndarray]:
    """The predictor (left, above) that takes a tenth off the entropy, or 0, and the samples less what it tells."""
    best, least = (0, samples), 0.9 * _entropy(np.bincount(samples.reshape(-1)))
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    left[1:, 0] -= samples[:-1, 0]
    above[1:] -= samples[:-1]
    above[0, 1:] -= samples[0, :-1]
    for mode, rest in ((1, left), (2, above)):
        if (bits := _entropy(np.bincount(rest.reshape(-1)))) < least:
            best, least = (mode, rest), bits
    return best


def encode(samples: np.ndarray) -> bytes:
    """A (height, width) array of 8-bit samples as an image of these green values."""
    height, width = samples.shape
    to = Writer()
    to.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 40)
    seen = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    bundle = _bundle(len(seen))
    if bundle:
        to.put(1 | PALETTE << 1 | (len(seen) - 1) << 3, 11)
        to.put(0, 1)
        place = np.zeros(256, np.int64)
        place[seen] = np.arange(len(seen))
        index = place[samples]
        steps = np.diff(seen, prepend=0)
        lengths = code_lengths(np.bincount(steps, minlength=256 + LENGTH_CODES).tolist(), 15)
        # alpha is 255 in the first colour and the same in all, so its steps are 255 and zeros
        alpha = [1] + [0] * 254 + [1] if len(seen) > 1 else [0] * 255 + [1]
        for code in (lengths, [1], [1], alpha, [1]):
            write_code(to, code)
        green = canonical(lengths) if np.count_nonzero(lengths) > 1 else None
        for i, s in enumerate(steps.tolist()):
            if green:
                to.put(*green[s])
            if len(seen) > 1:
                to.put(int(i == 0), 1)
        depth = 8 >> bundle
        short = -width % (1 << bundle)
        index = np.pad(index, ((0, 0), (0, short))).reshape(height, -1, 1 << bundle)
        samples = (index << (depth * np.arange(1 << bundle))).sum(axis=2)
    mode, samples = (0, samples) if bundle else _predicted(samples.astype(np.uint8))
    if mode:
        to.put(1 | PREDICTOR << 1 | 7 << 3, 6)  # blocks of 512 by 512, all of one mode
        to.put(0, 1)
        for symbol in (mode, 0, 0, 0, 0):
            write_lone(to, symbol)
    to.put(0, 3)  # no further transform, no colour cache, one group of codes
    _write_samples(to, samples.reshape(-1).astype(np.int64), samples.shape[1], 0 if mode else 255)
    body = to.data()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk
