"""Scalar functions on pitches, levels, masks, times and names, as Column expressions.

All rounding is half-even (``bround``); a division that can meet zero is guarded, since the session
may run in ANSI mode.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch class names, the black keys' classes, the A above middle C (fixed values).
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
BLACK_KEYS = (1, 3, 6, 8, 10)
A4_MIDI, A4_HZ = 69.0, 440.0
#: Corner frequencies of the A curve in Hz, its reference and its compression (fixed values).
A_CORNERS, A_REFERENCE, A_COMPRESSION = (20.6, 107.7, 737.9, 12194.0), 1000.0, 0.25
#: Range of a gamma, and the shortest span of a view in milliseconds (fixed values).
GAMMA_LOW, GAMMA_HIGH, LEAST_SPAN_MS = 0.6, 5.0, 1000.0
#: Steps between the ticks of a time axis (fixed values).
TICK_STEPS_MS = (1000, 2000, 5000, 10000, 15000, 30000, 60000, 120000, 300000, 600000)
#: Ticks of a quarter note and the tempo where none is given (fixed values).
TICKS, DEFAULT_BPM = 480, 120.0


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def midi_to_hz(pitch: Column) -> Column:
    return A4_HZ * F.pow(F.lit(2.0), (pitch - A4_MIDI) / 12.0)


def note_name(pitch: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


def is_black_key(pitch: Column) -> Column:
    return F.pmod(pitch, F.lit(12)).isin(*BLACK_KEYS)


def hann(i: Column, win: int) -> Column:
    """The periodic Hann window."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / win)


def hann_centred(i: Column, length: Column) -> Column:
    """The Hann window at sample centres, which is nowhere zero; windows that overlap by half add up to 1."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * (i + 0.5) / length)


def decibels(magnitude: Column, peak: Column, floor_db: float) -> Column:
    return F.greatest(10 * F.log10(F.greatest(F.try_divide(magnitude, peak), F.lit(1e-12))), F.lit(-floor_db))


def quantise(db: Column, range_db: float, digits: int | None = None) -> Column:
    """Whole steps of 0 to 255, half-even; digits: of a rounding before that, so that the order of additions does not decide a half."""
    level = clamp((db + range_db) / range_db, 0.0, 1.0) * 255
    return F.bround(level if digits is None else F.round(level, digits)).cast("int")


def dequantise(q: Column, range_db: float) -> Column:
    return q / 255.0 * range_db - range_db


def _a_response(f: float | Column) -> Column:
    f2 = F.pow(F.lit(f) if not isinstance(f, Column) else f, F.lit(2.0))
    a, b, c, d = (x**2 for x in A_CORNERS)
    return d * f2 * f2 / ((f2 + a) * F.sqrt((f2 + b) * (f2 + c)) * (f2 + d))


def a_weighting(hz: Column) -> Column:
    return F.pow(_a_response(hz) / _a_response(A_REFERENCE), F.lit(A_COMPRESSION))


def wiener(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return a * a / (a * a + b * b + eps)


def fuse(a1: Column, a2: Column, b1: Column, b2: Column, eps: float = 1e-10) -> Column:
    """The share of the geometric mean of two masks against that of their complements."""
    a, b = F.sqrt(a1 * a2), F.sqrt(b1 * b2)
    return a / (a + b + eps)


def soft_threshold(x: Column, by) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def tempo(bpm: Column) -> Column:
    """The tempo, or the default where it is no positive finite number."""
    b = bpm.try_cast("double") if hasattr(bpm, "try_cast") else bpm.cast("double")
    return F.when((b > 0) & ~F.isnan(b) & (b < float("inf")), b).otherwise(DEFAULT_BPM)


def ticks(seconds: Column, bpm: Column) -> Column:
    return F.bround(seconds * TICKS * bpm / 60.0).cast("long")


def velocity(confidence: Column) -> Column:
    return clamp(64 + F.bround(63 * confidence), 1, 127).cast("int")


def slug(name: Column, default: str = "track") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def base_name(path: Column, default: str = "upload") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1), F.lit("")), F.lit(default))


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def makeup_db(mix_peak: Column, stem_peak: Column) -> Column:
    return clamp(20 * F.log10(F.greatest(mix_peak, F.lit(1e-9)) / F.greatest(stem_peak, F.lit(1e-6))), 0.0, 12.0)


def fader_text(level: Column) -> Column:
    db = F.bround(20 * F.log10(F.greatest(level, F.lit(1e-12))), 1)
    return F.when(level <= 1e-4, "−∞").otherwise(F.concat(F.when(db > 0, "+").otherwise(""), F.format_string("%.1f", db)))


def intensity(q: Column, gain_db: float, range_db: float, gamma: float) -> Column:
    return F.pow(clamp(q + gain_db / range_db, 0.0, 1.0), F.lit(1 / max(0.01, gamma)))


def axis_ms(seconds: Column, offset: float, epoch_ms: int) -> Column:
    return epoch_ms + (seconds - offset) * 1000


def media_seconds(ms: Column, offset: float, epoch_ms: int) -> Column:
    return (ms - epoch_ms) / 1000.0 + offset


def clock_text(ms: Column) -> Column:
    """mm:ss:mmm"""
    whole = F.floor(ms)
    return F.concat(F.lpad(F.floor(whole / 60000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(whole / 1000) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 1000).cast("string"), 3, "0"))


def iso_text(ms: Column) -> Column:
    """Milliseconds since 1970 as ISO 8601 in UTC, whatever the session's time zone is."""
    day, rest = F.floor(ms / 86400000), F.pmod(F.floor(ms), F.lit(86400000))
    parts = ((rest / 3600000, 24, 2, "T"), (rest / 60000, 60, 2, ":"), (rest / 1000, 60, 2, ":"), (rest, 1000, 3, "."))
    digits = [x for part, of, n, mark in parts for x in (F.lit(mark), F.lpad((F.floor(part) % of).cast("string"), n, "0"))]
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), *digits, F.lit("Z"))


def stamp_ms(text: Column) -> Column:
    """Milliseconds since 1970 of a date and time in UTC, with T or a space between and Z or nothing after; null for other texts."""
    plain = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?\s*Z?$"
    read = F.concat(F.regexp_replace(text, r"\s*Z?$", ""), F.lit("Z")).try_cast("timestamp")
    return F.when(text.rlike(plain), F.floor(F.unix_micros(read) / 1000 + 0.5))


def tick_ms(span_ms: Column) -> Column:
    """The first step between ticks that gives at most 16 of them, or the longest."""
    fits = F.filter(F.array(*map(F.lit, TICK_STEPS_MS)), lambda step: span_ms / step <= 16)
    return F.coalesce(F.array_min(fits), F.lit(TICK_STEPS_MS[-1]))


def sought(at: Column, by: Column, offset, limit) -> Column:
    """Where a jump from a place ends: not beyond the limit, nor before the offset."""
    return F.greatest(F.least(at + by, F.lit(limit)), F.lit(offset))


def follow_start(playhead: Column, start: Column, span: Column, low: Column, high: Column) -> Column:
    """Where a view that follows the playhead begins: it moves once the playhead is in the first 5 or the last 15 per cent."""
    moved = F.least(F.greatest(playhead - 0.1 * span, low), high - span)
    return F.when((playhead < start + 0.05 * span) | (playhead > start + 0.85 * span), moved).otherwise(start)


def gamma_anchor(p: Column, gamma: Column) -> Column:
    """Where an anchor of a colour scale moves under a gamma, which is kept within its range."""
    return F.pow(p, clamp(gamma, GAMMA_LOW, GAMMA_HIGH))


def key_range(low: int, high: int, sub: int) -> tuple[float, float]:
    """Ends, in rows, of the pitches from low to high with sub rows each."""
    return low * sub - 0.5, (high + 1) * sub - 0.5


def row_centre(pitch: Column, sub: int) -> Column:
    return pitch * sub + (sub - 1) / 2.0


def plot_fraction(row: Column, low: int, high: int, sub: int) -> Column:
    """How far down from the top of the range a row is."""
    a, b = key_range(low, high, sub)
    return (b - row) / (b - a)


def kept_within(start: Column, span: Column, low, high) -> tuple[Column, Column]:
    """A range of this span moved so that it lies within the bounds; all of them if it is wider."""
    wide = span >= F.lit(high) - F.lit(low)
    moved = F.least(F.greatest(start, F.lit(low)), F.lit(high) - span)
    return F.when(wide, F.lit(low)).otherwise(moved), F.when(wide, F.lit(high)).otherwise(moved + span)


def zoomed(start: Column, end: Column, factor: Column, anchor: Column, low, high) -> tuple[Column, Column]:
    """A range whose span is multiplied while the anchor keeps its place in it; without an anchor its middle does."""
    span = end - start
    wanted = F.least(F.greatest(F.bround(span * factor), F.lit(LEAST_SPAN_MS)), F.lit(high) - F.lit(low))
    share = F.when(anchor.isNull() | (span <= 0), 0.5).otherwise(clamp(F.try_divide(anchor - start, span), 0.0, 1.0))
    return kept_within(start + share * (span - wanted), wanted, low, high)


def panned(start: Column, end: Column, by: Column, low, high) -> tuple[Column, Column]:
    return kept_within(start + by, end - start, low, high)


def columns_of(seconds: Column, rate: Column, least: int = 60, most: int | None = None) -> Column:
    """Columns of a spectrogram of so many seconds at a rate."""
    wanted = F.greatest(F.lit(least), F.bround(rate * seconds).cast("int"))
    return wanted if most is None else F.least(wanted, F.lit(most))


def preferred(wanted: Column, available: Column, last: str) -> Column:
    """The wanted names that are available, in the order wanted and once each, with ``last`` at the end where it is missing."""
    held = F.array_distinct(F.filter(wanted, lambda x: F.array_contains(available, x)))
    return F.when(F.array_contains(held, last), held).otherwise(F.array_append(held, F.lit(last)))


def missing(registry: Column, found: Column) -> Column:
    """The names of the registry that were not found, in its order."""
    return F.array_except(registry, found)


def in_order(found: Column, registry: Column) -> Column:
    """The names that were found, an error unless they are those of a registry in its order."""
    said = F.concat(F.lit("expected "), F.array_join(registry, ", "), F.lit(", found "), F.array_join(found, ", "))
    return F.when(found == registry, found).otherwise(F.raise_error(said))
