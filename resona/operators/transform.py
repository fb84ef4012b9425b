"""Fourier transforms of framed signals and back, in Arrow batches: one group is a bounded block of frames or samples.

A block takes along the samples, or frames, beyond its ends that it needs, so blocks are independent
of each other and a track of any length is many of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .spectral import n_frames

NUMBERS = ArrayType(DoubleType())
#: Frames of a block.
BLOCK = 256


def default_hop(win: int) -> int:
    return win - win * 3 // 4


def checked_hop(win: int, hop: int | None) -> int:
    hop = default_hop(win) if hop is None else hop
    if not 1 <= hop < win:
        raise ValueError(f"the hop must be at least 1 and below the window of {win}, not {hop}")
    return hop


def window(win: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)


def lists(values: np.ndarray) -> pa.ListArray:
    """A column with a row of the matrix in each row."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.reshape(-1)))


def rows(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    held = column.combine_chunks()
    return held.flatten().to_numpy().reshape(len(held), -1)


def stft(signal: DataFrame, win: int, hop: int | None = None, block: int = BLOCK) -> DataFrame:
    """(track, frame, re, im): the windowed transform of each frame over the window's sum; half a window of zeros at both ends."""
    hop, half = checked_hop(win, hop), win // 2
    sizes = signal.groupBy("track").agg(n_frames(F.max("n") + 1, win, hop).alias("frames"))
    first = F.greatest(F.lit(0), F.floor((F.col("n") - half) / hop) + 1)
    last = F.least(F.col("frames") - 1, F.floor((F.col("n") + half) / hop))
    touched = F.explode(F.sequence(F.floor(first / block), F.floor(last / block))).alias("block")
    held = signal.join(sizes, "track").where(first <= last).select("track", "n", "v", "frames", touched)

    def run(part: pa.Table) -> pa.Table:
        b, frames = part.column("block")[0].as_py(), part.column("frames")[0].as_py()
        count = min(block, frames - b * block)
        start = b * block * hop - half
        padded = np.zeros((count - 1) * hop + win)
        at = part.column("n").to_numpy() - start
        inside = (at >= 0) & (at < len(padded))
        padded[at[inside]] = part.column("v").to_numpy()[inside]
        w = window(win)
        z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, win)[::hop] * w, axis=1) / w.sum()
        track = part.column("track").slice(0, 1).combine_chunks().take(pa.array(np.zeros(count, np.int64)))
        return pa.table({"track": track, "frame": b * block + np.arange(count), "re": lists(z.real), "im": lists(z.imag)})

    schema = signal.select("track").schema.add("frame", "long").add("re", NUMBERS).add("im", NUMBERS)
    return held.groupBy("track", "block").applyInArrow(run, schema)


def istft(spectra: DataFrame, sizes: DataFrame, win: int, hop: int | None = None, block: int = BLOCK, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, n, v): overlap-add of the inverse transforms over the sum of the squared windows, cut to sizes (track, samples)."""
    hop, half = checked_hop(win, hop), win // 2
    span = block * hop
    start = F.col("frame") * hop - half
    low, high = F.floor(F.greatest(start, F.lit(0)) / span), F.floor(F.least(start + win - 1, F.col("samples") - 1) / span)
    touched = F.explode(F.sequence(low, high)).alias("block")
    held = spectra.join(sizes, "track").where((start < F.col("samples")) & (start + win > 0))
    held = held.select(*by, "frame", "re", "im", F.col("samples").cast("long").alias("samples"), touched)

    def run(part: pa.Table) -> pa.Table:
        b, samples = part.column("block")[0].as_py(), part.column("samples")[0].as_py()
        w = window(win)
        parts = np.fft.irfft(rows(part.column("re")) + 1j * rows(part.column("im")), n=win, axis=1) * (w.sum() * w)
        at = part.column("frame").to_numpy() * hop - half - b * span + win
        total, norm = np.zeros(span + 2 * win), np.zeros(span + 2 * win)
        for i, x in zip(at.tolist(), parts, strict=True):
            total[i : i + win] += x
            norm[i : i + win] += w * w
        n = np.arange(b * span, min((b + 1) * span, samples))
        own = slice(win, win + len(n))
        good = norm[own] > 1e-12 * max(norm.max(), 1.0)
        v = np.divide(total[own], norm[own], out=np.zeros(len(n)), where=good)
        keys = {c: part.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(n), np.int64))) for c in by}
        return pa.table({**keys, "n": n, "v": v})

    schema = held.select(*by).schema.add("n", "long").add("v", "double")
    return held.groupBy(*by, "block").applyInArrow(run, schema)


def magnitudes(spectra: DataFrame) -> DataFrame:
    """(track, frame, m)"""
    return spectra.select("track", "frame", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)).alias("m"))


def masked(spectra: DataFrame, masks: DataFrame, stems: tuple[str, ...]) -> DataFrame:
    """(track, stem, frame, re, im): the spectra times each stem's mask; masks: (track, frame, an array column for each stem)."""
    held = spectra.join(masks, ["track", "frame"])
    times = lambda c, stem: F.zip_with(c, stem, lambda a, b: a * b)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stem"), times("re", s).alias("re"), times("im", s).alias("im")) for s in stems)))
    return held.select("track", "frame", each.alias("e")).select("track", "e.stem", "frame", "e.re", "e.im")


def slices(frames: DataFrame, seconds: float, rate: int, hop: int) -> DataFrame:
    """The frames with ``slice``, consecutive spans of about so many seconds."""
    return frames.withColumn("slice", F.floor(F.col("frame") / slice_rows(seconds, rate, hop)))


def slice_rows(seconds: float, rate: int, hop: int) -> int:
    return max(1, round(seconds * rate / hop))


def context_frames(median: int = 31) -> int:
    """Frames beyond both ends of a block that a median of so many frames needs."""
    if median < 1 or median % 2 == 0:
        raise ValueError("median windows must be odd")
    return median // 2
