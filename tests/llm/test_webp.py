"""Images written with every feature of the format, and read back."""

import numpy as np
import pytest

from resona.llm import media, webp
from resona.llm.webp import Writer, canonical, code_lengths, write_code


def ch(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


def argb(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def guess(mode, left, top, right, corner):
    """The format's 14 predictors, written out a channel at a time."""
    l, t, r, c = map(ch, (left, top, right, corner))  # noqa: E741
    half = lambda a, b: (a + b) // 2
    clip = lambda x: 0 if x < 0 else 255 if x > 255 else x
    trunc = lambda x: -(-x // 2) if x < 0 else x // 2
    if mode == 11:
        return left if sum(abs(t[i] - c[i]) for i in range(4)) < sum(abs(l[i] - c[i]) for i in range(4)) else top
    f = {
        0: lambda i: 255 if i == 0 else 0, 1: lambda i: l[i], 2: lambda i: t[i], 3: lambda i: r[i], 4: lambda i: c[i],
        5: lambda i: half(half(l[i], r[i]), t[i]), 6: lambda i: half(l[i], c[i]), 7: lambda i: half(l[i], t[i]), 8: lambda i: half(c[i], t[i]),
        9: lambda i: half(t[i], r[i]), 10: lambda i: half(half(l[i], c[i]), half(t[i], r[i])), 12: lambda i: clip(l[i] + t[i] - c[i]),
        13: lambda i: clip(half(l[i], t[i]) + trunc(half(l[i], t[i]) - c[i])),
    }[mode]
    return argb([f(i) for i in range(4)])


def prefix(value):
    """(prefix, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v, n = value - 1, (value - 1).bit_length() - 1
    second = v >> (n - 1) & 1
    return 2 * n + second, v & ((1 << (n - 1)) - 1), n - 1


def write_image(to, pixels, width, main, cache_bits=0, groups=None, copies=True):
    """Pixels with literals, back-references and cache hits, in one group of codes or (bits, group of each block)."""
    to.put(1 if cache_bits else 0, 1)
    if cache_bits:
        to.put(cache_bits, 4)
    n_groups, group_of = 1, lambda i: 0
    if main:
        to.put(1 if groups else 0, 1)
        if groups:
            bits, blocks = groups
            across = -(-width // (1 << bits))
            to.put(bits - 2, 3)
            write_image(to, [b << 8 for b in blocks], across, False)
            n_groups, group_of = max(blocks) + 1, lambda i: blocks[(i // width >> bits) * across + (i % width >> bits)]
    size = 1 << cache_bits if cache_bits else 0
    cache, tokens, i = [0] * size, [], 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        best, back = 0, 0
        for d in range(1, min(i, 3 * width) + 1) if copies else ():
            k = 0
            while i + k < len(pixels) and k < 40 and pixels[i + k] == pixels[i + k - d]:
                k += 1
            if k > best:
                best, back = k, d
        if best >= 3:
            tokens.append((i, "copy", best, back))
            step = best
        elif size and cache[slot(pixels[i])] == pixels[i]:
            tokens.append((i, "cache", slot(pixels[i]), 0))
            step = 1
        else:
            tokens.append((i, "pixel", pixels[i], 0))
            step = 1
        for p in pixels[i : i + step] if size else ():
            cache[slot(p)] = p
        i += step
    near = {}
    for k, (x, y) in reversed(list(enumerate(webp.NEARBY, 1))):
        if x + y * width >= 1:
            near[x + y * width] = k
    parts = []
    for i, kind, a, d in tokens:
        if kind == "copy":
            (p, e, n), (q, f, m) = prefix(a), prefix(near.get(d, d + 120))
            parts.append((group_of(i), [(0, 256 + p), (None, e, n), (4, q), (None, f, m)]))
        elif kind == "cache":
            parts.append((group_of(i), [(0, 280 + a)]))
        else:
            alpha, red, green, blue = ch(a)
            parts.append((group_of(i), [(0, green), (1, red), (2, blue), (3, alpha)]))
    codes = []
    for g in range(n_groups):
        counts = [[0] * n for n in (280 + size, 256, 256, 256, 40)]
        for own, part in parts:
            for x in part:
                if own == g and x[0] is not None:
                    counts[x[0]][x[1]] += 1
        held = [code_lengths(c, 15) for c in counts]
        for lengths in held:
            write_code(to, lengths)
        codes.append([canonical(x) if sum(map(bool, x)) > 1 else None for x in held])
    for g, part in parts:
        for x in part:
            if x[0] is None:
                to.put(x[1], x[2])
            elif codes[g][x[0]]:
                to.put(*codes[g][x[0]][x[1]])


def build(image, predictor=None, cross=None, green=False, **options):
    height, width = image.shape
    to, pixels = Writer(), [int(p) for p in image.reshape(-1)]
    to.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    if predictor:
        to.put(1 | 0 << 1 | 0 << 3, 6)
        across = -(-width // 4)
        write_image(to, [m << 8 for m in predictor], across, False)
        out = []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            if i == 0:
                g = 0xFF000000
            elif y == 0:
                g = pixels[i - 1]
            elif x == 0:
                g = pixels[i - width]
            else:
                g = guess(predictor[(y // 4) * across + x // 4], pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])
            out.append(argb([(a - b) & 255 for a, b in zip(ch(p), ch(g), strict=True)]))
        pixels = out
    if cross:
        to.put(1 | 1 << 1 | 0 << 3, 6)
        across = -(-width // 4)
        write_image(to, cross, across, False)
        signed = lambda v: v - 256 if v > 127 else v
        out = []
        for i, p in enumerate(pixels):
            (a, r, g, b), (_, rb, gb, gr) = ch(p), ch(cross[(i // width // 4) * across + i % width // 4])
            d = lambda t, c: (signed(t) * signed(c)) >> 5
            out.append(argb([a, (r - d(gr, g)) & 255, g, (b - d(gb, g) - d(rb, r)) & 255]))
        pixels = out
    if green:
        to.put(1 | 2 << 1, 3)
        pixels = [argb([a, (r - g) & 255, g, (b - g) & 255]) for a, r, g, b in map(ch, pixels)]
    to.put(0, 1)
    write_image(to, pixels, width, True, **options)
    return wrap(to)


def wrap(to):
    body = to.data()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def picture(seed=0, height=13, width=18):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 256, (5, 4))
    image = c[rng.integers(0, 5, (height, width))] + rng.integers(0, 2, (height, width, 1)) * 3
    image[4:8] = image[0:4]
    c = image & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


@pytest.mark.parametrize("options", [
    {}, {"copies": False}, {"cache_bits": 4}, {"cache_bits": 11}, {"green": True}, {"groups": (2, [i % 3 for i in range(20)])},
    {"predictor": [i % 14 for i in range(20)]}, {"cross": [argb([255, 40 * i & 255, 90 + i, 200 - i]) for i in range(20)]},
    {"predictor": [13 - i % 14 for i in range(20)], "cross": [argb([255, i * 37 & 255, i * 91 & 255, i * 53 & 255]) for i in range(20)], "green": True, "cache_bits": 3, "groups": (3, [0, 1, 1, 0, 1, 0])},
])
def test_every_feature(options):
    image = picture()
    assert (webp.decode(build(image, **options)) == image).all()


@pytest.mark.parametrize("kinds", [1, 2, 3, 4, 5, 16, 17, 256])
def test_samples_and_palettes(kinds):
    samples = np.random.default_rng(kinds).integers(0, kinds, (37, 64)).astype(np.uint8) * (255 // max(kinds - 1, 1))
    image = webp.decode(webp.encode(samples))
    assert (image >> 8 & 255 == samples).all() and (image >> 24 == 255).all()


def encoded(samples):
    """The bytes of an image that gives these samples back, opaque."""
    stored = webp.encode(samples)
    image = webp.decode(stored)
    assert (image >> 8 & 255 == samples).all() and (image >> 24 == 255).all()
    return stored


@pytest.mark.parametrize("seed", range(40))
def test_encoder_round_trips(seed):
    rng = np.random.default_rng(seed)
    height, kinds = int(rng.integers(1, 40)), int(rng.integers(1, 257))
    plain = rng.integers(0, kinds, (height, 64))
    for samples in (
        plain, np.concatenate([plain, plain[::-1], plain]), np.cumsum(plain & 1, axis=1), np.cumsum(plain % 3, axis=0),
        np.resize(plain.reshape(-1)[: rng.integers(1, 90)], (height, 64)), np.resize(plain, (height, int(rng.integers(1, 70)))),
    ):
        encoded((samples & 255).astype(np.uint8))


def test_encoder_uses_copies_and_predictors():
    rng = np.random.default_rng(1)
    once = rng.integers(32, 128, (40, 64)).astype(np.uint8)
    alone, twice = len(encoded(once)), len(encoded(np.concatenate([once, once])))
    assert twice < alone + 40
    apart = np.concatenate([once, rng.integers(0, 256, (600, 64)).astype(np.uint8), once])
    assert (webp.decode(webp.encode(apart)) >> 8 & 255 == apart).all()  # too far back for a copy
    for axis in (0, 1):
        ramp = (np.cumsum(rng.integers(0, 4, (64, 64)), axis=axis) & 255).astype(np.uint8)
        assert len(encoded(ramp)) < ramp.size * 0.3
    long = np.concatenate([once, np.full((200, 64), 7, np.uint8), once])
    assert len(encoded(long)) < alone + 60


def test_a_copy_from_before_the_image_raises():
    to = Writer()
    to.put(0x2F | 7 << 8 | 0 << 22, 40)
    to.put(0, 3)
    green = [0] * 280
    green[65] = green[256 + 3] = 1
    for lengths in (green, [1], [1], [0] * 255 + [1], [0] * 5 + [1] + [0] * 34):
        write_code(to, lengths)
    codes = canonical(green)
    for symbol in (65, 256 + 3, 65, 65, 65):
        to.put(*codes[symbol])
        if symbol > 255:
            to.put(1, 1)  # distance prefix 5 has one extra bit
    with pytest.raises(webp.CorruptImage, match="leaves the image"):
        webp.decode(wrap(to))


def test_skewed_counts_keep_codes_short():
    counts = [1, 1]
    while len(counts) < 40:
        counts.append(counts[-1] + counts[-2])
    lengths = code_lengths(counts, 15)
    assert max(lengths) <= 15 and abs(sum(2.0**-n for n in lengths) - 1) < 1e-12


def test_long_payload_goes_on_in_further_images():
    payload = (b"abcdefgh" * 40 + bytes(range(256))) * 2000
    payload += b"\0" * (-len(payload) % 64)
    assert len(payload) > media.IMAGE
    assert b"".join((x >> 8 & 255).astype(np.uint8).tobytes() for x in media.images(media.to_images(payload))) == payload


def test_corrupt_bytes_raise():
    with pytest.raises(webp.CorruptImage):
        webp.decode(b"no image")
    whole = webp.encode(np.random.default_rng(0).integers(0, 256, (40, 64)).astype(np.uint8))
    with pytest.raises(webp.CorruptImage):
        webp.decode(whole[:400])


def test_nearby_offsets():
    assert len(webp.NEARBY) == 120 and webp.NEARBY[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEARBY[-1] == (8, 7)
