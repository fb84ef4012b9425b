"""Framing, transforms, pitch bands, pooling and peaks.

A frame is a row with its bins in an array, so what stays within a frame needs no shuffle; bands are
contiguous ranges of bins that are worked out once, on a dimension of a few hundred rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import scalars as S

#: Lowest and highest pitch of the rows (fixed values).
LOW, HIGH = 21, 108


def hz(pitch: float) -> float:
    return 440.0 * 2.0 ** ((pitch - 69.0) / 12.0)


def bands(n_bins: int, win: int, rate: int, sub: int = 1) -> list[tuple[int, int, int]]:
    """(row, first bin, number of bins): the bins in [low edge, high edge), or the one nearest to the centre where there is none."""
    freqs = [b * rate / win for b in range(n_bins)]
    out = []
    for row in range((HIGH - LOW + 1) * sub):
        pitch, part = LOW + row // sub, row % sub
        low, high = hz(pitch - 0.5), hz(pitch + 0.5)
        a, b = (low * (high / low) ** (x / sub) for x in (part, part + 1))
        inside = [i for i, f in enumerate(freqs) if a <= f < b]
        centre = hz(pitch) if sub == 1 else math.sqrt(a * b)
        out.append((row, inside[0], len(inside)) if inside else (row, min(range(n_bins), key=lambda i: (abs(freqs[i] - centre), i)), 1))
    return out


def kinds(rate: int, win: int, sub: int = 1) -> tuple[list[tuple[int, int]], list[int]]:
    """Ranges (first bin, number of bins), and for each row the place of its own among them.

    Rows of one range have one power, so it is enough to pool that; where rows are widened, each stays.
    """
    held = [(a, n) for _, a, n in bands(win // 2 + 1, win, rate, sub)]
    if sub > 1:
        return held, list(range(len(held)))
    found = sorted(set(held))
    return found, [found.index(x) for x in held]


def band_power(frames: DataFrame, rate: int, win: int, sub: int = 1, m: str = "m", held: list[tuple[int, int]] | None = None) -> DataFrame:
    """The frames with ``p``, the power of each of the 88 * sub pitch rows, or of the ranges held."""
    held = held or [(a, n) for _, a, n in bands(win // 2 + 1, win, rate, sub)]
    ranges = F.array(*(F.struct(F.lit(a + 1).alias("at"), F.lit(n).alias("n")) for a, n in held))
    power = F.transform(m, lambda x: x * x)
    return frames.withColumn("_power", power).withColumn("p", F.transform(ranges, lambda b: F.aggregate(F.slice("_power", b["at"], b["n"]), F.lit(0.0), lambda s, x: s + x))).drop("_power")


def widen(values: Column, n: int, sub: int) -> Column:
    """A triangular kernel along an array of n rows, about a semitone wide, with the ends repeated."""
    if sub <= 1:
        return values
    half = max(1, sub // 2)
    kernel = [*range(1, half + 1), *range(half, 0, -1)]
    tap = lambda i, k: F.element_at(values, S.clamp(i + (k - half + 1), 0, n - 1) + 1) * (kernel[k] / sum(kernel))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: reduce(lambda a, b: a + b, (tap(i, k) for k in range(len(kernel)))))


def placed(frames: DataFrame, columns: int) -> DataFrame:
    """The frames with ``col``, their block of frames, so many that a track has at most ``columns``."""
    sizes = frames.groupBy("track").agg((F.max("frame") + 1).alias("frames"))
    block = F.greatest(F.lit(1), F.ceil(F.col("frames") / columns))
    return frames.join(sizes, "track").withColumn("col", F.floor(F.col("frame") / block)).drop("frames")


def pooled(frames: DataFrame, rows: int, values: str = "p") -> DataFrame:
    """(track, col, p): the maxima of placed frames, row by row, as an array.

    A column is one row whose maxima are kept as so many numbers, so there is no key for each cell.
    """
    tops = frames.groupBy("track", "col").agg(*(F.max(F.get(values, F.lit(i))).alias(f"_{i}") for i in range(rows)))
    return tops.select("track", "col", F.array(*(f"_{i}" for i in range(rows))).alias("p"))


def pool(frames: DataFrame, columns: int, values: str = "p") -> DataFrame:
    """(track, row, col, p): maxima of blocks of frames, so many that a track has at most ``columns``."""
    held = placed(frames, columns).select("track", "col", F.posexplode(values).alias("row", "p"))
    return held.groupBy("track", "row", "col").agg(F.max("p").alias("p"))


def quantised(cells: DataFrame, range_db: float = 70.0, joint: bool = False, digits: int | None = None) -> DataFrame:
    """The cells with q in place of p, a number or an array, against the greatest of a track's cells, or of all (joint); silence is an error."""
    arrays = isinstance(cells.schema["p"].dataType, ArrayType)
    peak = F.when(F.col("peak") > 0, F.col("peak")).otherwise(F.raise_error(F.lit("the signal is silent")).cast("double"))
    top = F.max(F.array_max("p") if arrays else "p").alias("peak")
    # the joint peak is one row
    held = cells.join(F.broadcast(cells.agg(top)), F.lit(True)) if joint else cells.join(cells.groupBy("track").agg(top), "track")
    others = [c for c in cells.columns if c != "p"]
    level = lambda p: S.quantise(S.decibels(p, peak, range_db), range_db, digits)
    return held.select(*others, (F.transform("p", level) if arrays else level(F.col("p"))).alias("q"))


def n_frames(n: Column, win: int, hop: int) -> Column:
    """Frames of a centred transform of n samples: half a window of zeros on both sides, and zeros up to a whole hop."""
    return 1 + F.floor((n + F.pmod(F.pmod(-n, F.lit(hop)), F.lit(win))) / hop)


def framed(signal: DataFrame, win: int, hop: int) -> DataFrame:
    """(track, n, v, frame, i): every sample in every frame that it is in, at place i."""
    sizes = signal.groupBy("track").agg(n_frames(F.max("n") + 1, win, hop).alias("frames"))
    first = F.greatest(F.lit(0), F.floor((F.col("n") - win // 2) / hop) + 1)
    last = F.least(F.col("frames") - 1, F.floor((F.col("n") + win // 2) / hop))
    held = signal.join(sizes, "track").where(first <= last).select("track", "n", "v", F.explode(F.sequence(first, last)).alias("frame"))
    return held.withColumn("i", F.col("n") - F.col("frame") * hop + win // 2)


def dft(signal: DataFrame, win: int = 16, hop: int | None = None) -> DataFrame:
    """(track, frame, re, im) as sums of products, for windows of a few samples; ``transform.stft`` is the one for all others."""
    hop = hop or win - win * 3 // 4
    held = framed(signal, win, hop).withColumn("x", F.col("v") * S.hann(F.col("i"), win))
    part = lambda f, k, sign: F.sum(sign * F.col("x") * f(2 * math.pi * k * F.col("i") / win)) / (win / 2)
    both = [F.array(*(part(f, k, s) for k in range(win // 2 + 1))) for f, s in ((F.cos, 1), (F.sin, -1))]
    return held.groupBy("track", "frame").agg(both[0].alias("re"), both[1].alias("im"))


def inverse(spectra: DataFrame, sizes: DataFrame, win: int = 16, hop: int | None = None, eps: float = 1e-12) -> DataFrame:
    """(track, n, v): overlap-add of the inverse transforms, over the sum of the squared windows; sizes: (track, samples)."""
    hop, half = hop or win - win * 3 // 4, win // 2
    place = spectra.select("track", "frame", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(win - 1))).alias("i"))
    terms = []
    for k in range(half + 1):
        angle = 2 * math.pi * k * F.col("i") / win
        terms.append((1 if k in (0, half) else 2) * (F.element_at("re", k + 1) * F.cos(angle) - F.element_at("im", k + 1) * F.sin(angle)))
    w = S.hann(F.col("i"), win)
    samples = place.select("track", (F.col("frame") * hop + F.col("i") - half).alias("n"), (reduce(lambda a, b: a + b, terms) / win * (win / 2) * w).alias("x"), (w * w).alias("w2"))
    added = samples.groupBy("track", "n").agg(F.sum("x").alias("x"), F.sum("w2").alias("w2"))
    return added.join(sizes, "track").where((F.col("n") >= 0) & (F.col("n") < F.col("samples"))).select("track", "n", F.when(F.col("w2") > eps, F.try_divide(F.col("x"), F.col("w2"))).otherwise(0.0).alias("v"))


def parabolic(left: Column, mid: Column, right: Column) -> tuple[Column, Column]:
    """Offset and height of the parabola's top through three neighbours; a flat one has offset 0."""
    bend = left - 2 * mid + right
    offset = F.when(bend != 0, F.try_divide(0.5 * (left - right), bend)).otherwise(0.0)
    return offset, mid - 0.25 * (left - right) * offset


def packed(cells: DataFrame, n_rows: int) -> DataFrame:
    """(track, n_cols, spec): the quantised cells row after row, as base64; cells that are missing are 0.

    A track is one value here, bounded by the rows and columns that pooling leaves.
    """

    def run(part: pa.Table) -> pa.Table:
        row, col = part.column("row").to_numpy(), part.column("col").to_numpy()
        n_cols = int(col.max()) + 1
        held = np.zeros((n_rows, n_cols), np.uint8)
        held[row, col] = part.column("q").to_numpy()
        return pa.table({"track": part.column("track").slice(0, 1), "n_cols": pa.array([n_cols], pa.int64()), "spec": [base64.b64encode(held.tobytes()).decode()]})

    schema = cells.select("track").schema.add("n_cols", "long").add("spec", "string")
    return cells.select("track", "row", "col", "q").groupBy("track").applyInArrow(run, schema)


def packed_columns(cells: DataFrame, places: list[int]) -> DataFrame:
    """(track, n_cols, spec, envelope) of columns (track, col, q), q an array that has each row's value at its place: as packed() has it, and the greatest of each column."""
    held = cells.groupBy("track").agg((F.max("col") + 1).alias("n_cols"), F.array_sort(F.collect_list(F.struct("col", "q"))).alias("all"))
    held = held.select("track", "n_cols", F.transform("all", lambda x: F.array_max(x["q"])).alias("envelope"), F.col("all.col").alias("cols"), F.flatten("all.q").alias("q"))
    schema = cells.select("track").schema.add("n_cols", "long").add("spec", "string").add("envelope", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specs, n_cols = [], batch.column("n_cols").to_pylist()
            for i, n in enumerate(n_cols):
                cols = batch.column("cols")[i].values.to_numpy()
                cells_ = np.zeros((len(places), n), np.uint8)
                cells_[:, cols] = batch.column("q")[i].values.to_numpy().reshape(len(cols), -1).T[places]
                specs.append(base64.b64encode(cells_.tobytes()).decode())
            yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("n_cols"), pa.array(specs, pa.string()), batch.column("envelope")], names=schema.names)

    return held.mapInArrow(run, schema)


def unpacked(packed_: DataFrame) -> DataFrame:
    """(track, row, col, q) from what packed() gives."""
    digits = F.hex(F.unbase64("spec"))
    cells = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))
    return packed_.select("track", "n_cols", cells.alias("k", "q")).select("track", F.floor(F.col("k") / F.col("n_cols")).alias("row"), (F.col("k") % F.col("n_cols")).alias("col"), "q")


def resampled(signal: DataFrame, up: int, down: int, lobes: int = 4) -> DataFrame:
    """(track, n, v) at up / down times the rate, through a sinc under a Hann window; the signal itself if the two are equal."""
    if up == down:
        return signal.select("track", "n", "v")
    wide = max(1.0, down / up)  # samples between two zeros of the kernel
    reach = lobes * wide
    sizes = signal.groupBy("track").agg(F.ceil((F.max("n") + 1) * up / down).alias("length"))
    low, high = F.ceil((F.col("n") - reach) * up / down), F.floor((F.col("n") + reach) * up / down)
    held = signal.join(sizes, "track").withColumn("m", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.col("length") - 1)))).withColumn("d", (F.col("m") * down / up - F.col("n")) / wide)
    sinc = F.when(F.abs("d") < 1e-12, 1.0).otherwise(F.try_divide(F.sin(math.pi * F.col("d")), math.pi * F.col("d")))
    weight = sinc * (0.5 + 0.5 * F.cos(math.pi * F.col("d") / lobes)) / wide
    return held.groupBy("track", F.col("m").alias("n")).agg(F.sum(F.col("v") * weight).alias("v"))
