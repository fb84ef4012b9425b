"""Signals as blocks: a row is a stretch of some seconds of a track, its samples an array.

``(by..., block, v)``: block b holds the samples from b * size on, ``size`` of them but in a track's last
block.  What looks beyond a block takes a halo from its neighbours, which is all that is shuffled
besides the blocks themselves; so a track of any length is many rows in many tasks, and no step has
a row for each sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import media
from .transform import NUMBERS, checked_hop, lists, rows, window

#: Samples of a block: about a second.
SIZE = 1 << 15


def to_blocks(signal: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Blocks of a signal (by..., n, v) that has a row for each sample, without gaps: for sources that have no blocks of their own."""
    held = signal.groupBy(*by, F.floor(F.col("n") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("held"))
    return held.select(*by, "block", F.transform("held", lambda x: x["v"].cast("double")).alias("v"))


def samples(blocks: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by..., n, v): a row for each sample again, without a shuffle."""
    held = blocks.select(*by, "block", F.posexplode("v").alias("i", "v"))
    return held.select(*by, (F.col("block") * size + F.col("i")).alias("n"), "v")


def lengths(blocks: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by..., samples)"""
    return blocks.groupBy(*by).agg(F.max(F.col("block") * size + F.size("v")).alias("samples"))


def with_halo(blocks: DataFrame, before: int, after: int, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """The blocks with head, the last ``before`` samples of the one before, tail, the first ``after`` of the next, and whether they are the last."""
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} samples is longer than a block of {size}")
    own = F.struct(F.col("block").alias("b"), F.lit(0).alias("part"), F.col("v").alias("v"))
    ahead = F.struct((F.col("block") + 1).alias("b"), F.lit(-1).alias("part"), F.slice("v", F.greatest(F.size("v") - before, F.lit(0)) + 1, before).alias("v"))
    behind = F.struct((F.col("block") - 1).alias("b"), F.lit(1).alias("part"), F.slice("v", F.lit(1), F.lit(after)).alias("v"))
    parts = blocks.select(*by, F.explode(F.array(own, ahead, behind)).alias("e")).select(*by, F.col("e.b").alias("block"), "e.part", "e.v")
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("v")))  # noqa: E731  one row of each kind a block
    met = parts.groupBy(*by, "block").agg(part(0).alias("v"), part(-1).alias("head"), part(1).alias("tail")).where("v is not null")
    none = F.expr("cast(array() as array<double>)")
    return met.select(*by, "block", "v", F.coalesce("head", none).alias("head"), F.coalesce("tail", none).alias("tail"), F.col("tail").isNull().alias("last"))


#: Bytes of results that are gathered before they go out as a batch.
FULL = 1 << 23


def _gathered(batch: pa.RecordBatch, by: tuple[str, ...], names: list[str], found: Iterator[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
    """found gives the columns that each row of a batch makes, of one length; those of many rows go out together, with their keys."""
    at, held, size = [], [], 0

    def out() -> pa.RecordBatch:
        row = pa.array(np.repeat(at, [len(x[0]) for x in held]), pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in by), *map(pa.concat_arrays, zip(*held, strict=True))], names=names)

    for i, columns in enumerate(found):
        if len(columns[0]):
            at.append(i)
            held.append(columns)
            size += sum(c.nbytes for c in columns)
        if size > FULL:
            yield out()
            at, held, size = [], [], 0
    if held:
        yield out()


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The samples of each row."""
    ends, values = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _each(blocks: DataFrame, by: tuple[str, ...], columns: list[T.StructField], work: Callable) -> DataFrame:
    """work(block, head, v, tail, last) of every block of with_halo(), which gives a dict of columns of one length."""
    schema = T.StructType([*blocks.select(*by).schema.fields, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, last = (batch.column(c).to_pylist() for c in ("block", "last"))
            made = (work(*x) for x in zip(block, *(_arrays(batch.column(c)) for c in ("head", "v", "tail")), last, strict=True))
            yield from _gathered(batch, by, schema.names, ([x[c.name] for c in columns] for x in made))

    return blocks.mapInArrow(run, schema)


def stft(blocks: DataFrame, win: int, hop: int | None = None, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by..., frame, re, im): the windowed transform of each frame over the window's sum, half a window of zeros at both ends.

    A frame is its block's in which its middle lies, and the last block's beyond the end.
    """
    hop, half = checked_hop(win, hop), win // 2
    shape = window(win)

    def work(block: int, head: np.ndarray, v: np.ndarray, tail: np.ndarray, last: bool) -> dict:
        base = block * size
        total = base + len(v)
        frames = 1 + (total + (-total % hop) % win) // hop if last else -(-(base + size) // hop)
        first = -(-base // hop)
        count = frames - first
        if count <= 0:
            return {"frame": pa.array([], pa.int64()), "re": pa.array([], pa.list_(pa.float64())), "im": pa.array([], pa.list_(pa.float64()))}
        held = np.zeros((count - 1) * hop + win)
        # the samples that are there, from the first frame's first place on
        there = np.concatenate([head, v, tail])
        at = base - len(head) - (first * hop - half)
        a, b = max(0, -at), min(len(there), len(held) - at)
        if a < b:
            held[at + a : at + b] = there[a:b]
        z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(held, win)[::hop][:count] * shape, axis=1) / shape.sum()
        return {"frame": pa.array(first + np.arange(count)), "re": lists(z.real), "im": lists(z.imag)}

    columns = [T.StructField("frame", T.LongType()), T.StructField("re", NUMBERS), T.StructField("im", NUMBERS)]
    return _each(with_halo(blocks, half, win, size, by), by, columns, work)


def istft(spectra: DataFrame, sizes: DataFrame, win: int, hop: int | None = None, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Blocks of the overlap-add of the inverse transforms over the sum of the squared windows, cut to sizes (track, samples)."""
    hop, half = checked_hop(win, hop), win // 2
    start = F.col("frame") * hop - half
    low, high = F.floor(F.greatest(start, F.lit(0)) / size), F.floor(F.least(start + win - 1, F.col("samples") - 1) / size)
    held = spectra.join(sizes, "track").where((start < F.col("samples")) & (start + win > 0))
    held = held.select(*by, "frame", "re", "im", F.col("samples").cast("long").alias("samples"), F.explode(F.sequence(low, high)).alias("block"))
    shape = window(win)

    def run(part: pa.Table) -> pa.Table:
        b, total = part.column("block")[0].as_py(), part.column("samples")[0].as_py()
        # frames a few at a time, so that the group's spectra are there once only
        added, norm = np.zeros(size + 2 * win), np.zeros(size + 2 * win)
        at = part.column("frame").to_numpy() * hop - half - b * size + win
        for a in range(0, len(at), 64):
            z = rows(part.column("re").slice(a, 64)) + 1j * rows(part.column("im").slice(a, 64))
            for i, x in zip(at[a : a + 64].tolist(), np.fft.irfft(z, n=win, axis=1) * (shape.sum() * shape), strict=True):
                added[i : i + win] += x
                norm[i : i + win] += shape * shape
        own = slice(win, win + min(size, total - b * size))
        good = norm[own] > 1e-12 * max(norm.max(), 1.0)
        v = np.divide(added[own], norm[own], out=np.zeros(own.stop - own.start), where=good)
        return pa.table({**{c: part.column(c).slice(0, 1) for c in (*by, "block")}, "v": lists(v[None, :])})

    schema = T.StructType([*held.select(*by, "block").schema.fields, T.StructField("v", NUMBERS)])
    return held.groupBy(*by, "block").applyInArrow(run, schema)


def chunked(blocks: DataFrame, plan: DataFrame, work: Callable, columns: list[T.StructField], size: int = SIZE) -> DataFrame:
    """work(samples, plan row as a dict) of each chunk of a plan (track, chunk, start, end, ...), its samples whole and in order.

    work gives rows as a dict of columns; the plan's columns stay.  Only the pieces of blocks that a chunk
    covers meet in its group.
    """
    touched = plan.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    a = F.greatest(F.col("start") - F.col("block") * size, F.lit(0)).cast("int")
    b = F.least(F.col("end") - F.col("block") * size, F.lit(size)).cast("int")
    pieces = touched.join(blocks.select("track", F.col("block"), F.col("v").alias("_v")), ["track", "block"]).withColumn("_v", F.slice("_v", a + 1, b - a))
    schema, names = T.StructType([*plan.schema.fields, *columns]), plan.columns
    # a chunk is a row, since a call of Python for each group of a few samples takes longer than its work
    whole = pieces.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("block", "_v"))).alias("_all"))
    whole = whole.select(*names, F.flatten("_all._v").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (work(*x) for x in zip(_arrays(batch.column("_v")), batch.select(names).to_pylist(), strict=True))
            yield from _gathered(batch, names, schema.names, ([x[c.name] for c in columns] for x in made))

    return whole.mapInArrow(run, schema)


@lru_cache(maxsize=8)
def _hann(n: int) -> np.ndarray:
    """A Hann window that is nowhere zero."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)


def blended(parts: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Blocks of overlapping chunks (by..., start, end, y), y an array, weighted by a Hann window that is nowhere zero."""
    touched = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("block")
    held = parts.select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "y", touched)
    # of each chunk only the part within the block goes along
    a = F.greatest(F.col("start"), F.col("block") * size)
    b = F.least(F.col("end"), (F.col("block") + 1) * size)
    held = held.withColumn("y", F.slice("y", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")))
    # a block is a row with the parts of its chunks in order
    parts_ = F.array_sort(F.collect_list(F.struct("start", "end", "y")))
    held = held.groupBy(*by, "block").agg(parts_.alias("all"))
    held = held.select(*by, "block", "all.start", "all.end", F.flatten("all.y").alias("y"))

    def blend(block: int, starts: list[int], ends: list[int], y: np.ndarray) -> np.ndarray:
        added, weights, top, at, base = np.zeros(size), np.zeros(size), 0, 0, block * size
        for start, end in zip(starts, ends, strict=True):
            a, b = max(start, base), min(end, base + size)
            w = _hann(end - start)[a - start : b - start] if end - start <= size else 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(a, b) - start + 0.5) / (end - start))
            added[a - base : b - base] += w * y[at : at + b - a]
            weights[a - base : b - base] += w
            top, at = max(top, b - base), at + b - a
        return added[:top] / np.maximum(weights[:top], 1e-30)

    schema = T.StructType([*held.select(*by, "block").schema.fields, T.StructField("v", NUMBERS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = map(blend, *(batch.column(c).to_pylist() for c in ("block", "start", "end")), _arrays(batch.column("y")))
            yield from _gathered(batch, (*by, "block"), schema.names, ([lists(v[None, :])] for v in made))

    return held.mapInArrow(run, schema)


#: Zeros of the low-pass on each side, and the shape of its Kaiser window (fixed values).
ZEROS, BETA = 10, 5.0


def low_pass(up: int, down: int) -> np.ndarray:
    """The taps of the filter of a change of rate: a sinc under a Kaiser window, with a sum of ``up``."""
    most = max(up, down)
    half = ZEROS * most
    taps = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, BETA)
    return up * taps / taps.sum()


def branches(up: int, down: int) -> tuple[np.ndarray, int]:
    """(phase, place): the taps that meet the samples around an output of each phase, and how many samples lie on each side."""
    taps = low_pass(up, down)
    half = len(taps) // 2
    reach = half // up + 1
    at = half + np.arange(up)[:, None] - np.arange(-reach, reach + 1)[None, :] * up
    return np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0), reach


def resampled(blocks: DataFrame, up: int, down: int, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Blocks at up / down times the rate, through a polyphase filter; the blocks themselves if the two are equal.

    Output m lies at m * down / up between the samples; the branch of its phase meets the samples around
    it.  A block makes the outputs that lie within it, which then are dealt to blocks anew.
    """
    common = int(np.gcd(up, down))
    up, down = up // common, down // common
    if up == down:
        return blocks
    bank, reach = branches(up, down)

    def work(block: int, head: np.ndarray, v: np.ndarray, tail: np.ndarray, last: bool) -> dict:
        base = block * size
        first, end = -(-base * up // down), -(-(base + len(v)) * up // down)
        held = np.concatenate([np.zeros(reach - len(head)), head, v, tail[:reach], np.zeros(max(0, reach - len(tail)))])
        out = np.zeros(end - first)
        for k in range(min(up, end - first)):  # outputs a multiple of ``up`` apart have one phase
            m = np.arange(first + k, end, up)
            at = m * down // up - base
            out[k::up] = np.lib.stride_tricks.sliding_window_view(held, 2 * reach + 1)[at] @ bank[(m[0] * down) % up]
        # pieces of the blocks of the result
        cuts = [first, *range((first // size + 1) * size, end, size), end] if end > first else [first]
        pieces = [out[a - first : b - first] for a, b in zip(cuts, cuts[1:], strict=False)]
        return {"n": pa.array(cuts[:-1], pa.int64()), "v": pa.array(pieces, pa.list_(pa.float64()))}

    parts = _each(with_halo(blocks, reach, reach, size, by), by, [T.StructField("n", T.LongType()), T.StructField("v", NUMBERS)], work)
    return _dealt(parts, size, by)


def rolled(blocks: DataFrame, shifts: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """Blocks of the signal moved on by a number of samples, what passes its end at its start; shifts: (track, samples, by)."""
    held = blocks.join(shifts.select("track", "samples", F.col("by").alias("_by")), "track")
    schema = T.StructType([*blocks.select(*by).schema.fields, T.StructField("n", T.LongType()), T.StructField("v", NUMBERS)])

    def cut_up(block: int, total: int, moved: int, v: np.ndarray) -> list[pa.Array]:
        pieces, at = [], 0
        while at < len(v):  # up to the end of a block, or of the signal
            n = (block * size + at + moved) % total
            end = at + min(len(v) - at, total - n, size - n % size)
            pieces.append((n, v[at:end]))
            at = end
        return [pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = map(cut_up, *(batch.column(c).to_pylist() for c in ("block", "samples", "_by")), _arrays(batch.column("v")))
            yield from _gathered(batch, by, schema.names, made)

    return _dealt(held.select(*by, "block", "v", "samples", "_by").mapInArrow(run, schema), size, by)


def _dealt(pieces: DataFrame, size: int, by: tuple[str, ...]) -> DataFrame:
    """Blocks of pieces (by..., n, v) that begin at n, none of them across two blocks."""
    held = pieces.groupBy(*by, F.floor(F.col("n") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("held"))
    return held.select(*by, "block", F.flatten(F.transform("held", lambda x: x["v"])).alias("v"))


def channels(held: DataFrame) -> DataFrame:
    """(track, channel, block, v) of blocks (track, ch, block, v): the mean of all channels, the first, and the second or again the first.

    What meets is the blocks of one place, as many as a file has channels.
    """
    met = held.groupBy("track", "block").agg(F.array_sort(F.collect_list(F.struct("ch", "v"))).alias("all"))
    one = lambda k: F.element_at("all", k)["v"]
    added = F.aggregate(F.slice("all", F.lit(2), F.size("all")), one(1), lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b))
    three = {
        "mix": F.transform(added, lambda x: x / F.size("all")),
        "left": one(1),
        "right": F.when(F.size("all") > 1, one(2)).otherwise(one(1)),
    }
    named = F.array(*(F.struct(F.lit(c).alias("channel"), v.alias("v")) for c, v in three.items()))
    return met.select("track", "block", F.explode(named).alias("e")).select("track", "e.channel", "block", "e.v")


def mono(held: DataFrame) -> DataFrame:
    """(track, block, v): the mean of the channels of blocks (track, ch, block, v)."""
    return mean(held.select("track", "block", "v"))


def pcm_parts(blocks: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by..., block, content): the 16-bit samples of each block; put together in order they are a track's."""
    schema = T.StructType([*blocks.select(*by, "block").schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column("v")[i].values.to_numpy(zero_copy_only=False) for i in range(batch.num_rows)]
            content = pa.array([media.pcm16(v) for v in held], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*by, "block")), content], names=schema.names)

    return blocks.select(*by, "block", "v").mapInArrow(run, schema)


def fingerprints(blocks: DataFrame) -> DataFrame:
    """(track, pcm16): the first 16 hex digits of the SHA-256 of a track's 16-bit samples.

    A task goes through its tracks' blocks in order and holds one batch of them and the state of one hash.
    """
    held = pcm_parts(blocks).repartition("track").sortWithinPartitions("track", "block")
    schema = blocks.select("track").schema.add("pcm16", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        told = lambda: pa.RecordBatch.from_arrays([key, pa.array([state.hexdigest()[:16]])], names=["track", "pcm16"])
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("track").slice(i, 1)
                if state is None or not own.equals(key):
                    if state is not None:
                        yield told()
                    key, state = own, hashlib.sha256()
                state.update(batch.column("content")[i].as_py())
        if state is not None:
            yield told()

    return held.mapInArrow(run, schema)


def wav_parts(blocks: DataFrame, rate: int, size: int = SIZE) -> DataFrame:
    """(track, block, content): a mono file of each track in parts, its header as block -1; no part needs another."""
    total = lengths(blocks, size).select("track", F.lit(-1).cast("long").alias("block"), (F.col("samples") * 2).alias("bytes"))
    hex_ = lambda n, width: F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i) % 256), 2, "0") for i in range(width)))
    number = lambda n, width=4: hex_(F.lit(n) if isinstance(n, int) else n, width)
    form = F.concat(number(16), number(1, 2), number(1, 2), number(rate), number(2 * rate), number(2, 2), number(16, 2))
    text = lambda s: F.lit(s.encode().hex())
    header = F.concat(text("RIFF"), number(F.col("bytes") + 36), text("WAVEfmt "), form, text("data"), number(F.col("bytes")))
    whole = F.when(F.col("bytes") + 36 < 1 << 32, F.unhex(header)).otherwise(F.raise_error(F.lit("a WAV file holds less than 4 GB")))
    return total.select("track", "block", whole.alias("content")).unionByName(pcm_parts(blocks))


def wav_files(blocks: DataFrame, rate: int, size: int = SIZE) -> DataFrame:
    """(track, content): the parts of wav_parts() as one value, for tracks of which one is small enough for that."""

    def run(part: pa.Table) -> pa.Table:
        held = part.sort_by("block")
        return pa.table({"track": held.column("track").slice(0, 1), "content": pa.array([b"".join(held.column("content").to_pylist())], pa.binary())})

    return wav_parts(blocks, rate, size).groupBy("track").applyInArrow(run, blocks.select("track").schema.add("content", "binary"))


def mean(blocks: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """The mean, sample by sample, of several blocks of one place."""
    held = blocks.groupBy(*by, "block").agg(F.collect_list("v").alias("all"))
    added = F.aggregate(F.slice("all", 2, 1 << 20), F.element_at("all", 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return held.select(*by, "block", F.transform(added, lambda x: x / F.size("all")).alias("v"))


def cut_to(blocks: DataFrame, sizes: DataFrame, size: int = SIZE) -> DataFrame:
    """The blocks without what lies beyond sizes (track, samples)."""
    left = F.col("samples") - F.col("block") * size
    return blocks.join(sizes, "track").where(left > 0).withColumn("v", F.slice("v", F.lit(1), F.least(left, F.lit(size)).cast("int"))).drop("samples")


def correlated(blocks: DataFrame, lags: int, size: int = SIZE, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by..., lag, ac): sums of products of the demeaned samples with those lag steps on, over the greatest of them.

    A block and the samples before it are transformed once, so the cost hardly depends on the number of lags.
    """
    means = blocks.groupBy(*by).agg((F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("v"))).alias("mean"))
    less = blocks.join(means, list(by)).select(*by, "block", F.transform("v", lambda x: x - F.col("mean")).alias("v"))

    def work(block: int, head: np.ndarray, v: np.ndarray, tail: np.ndarray, last: bool) -> dict:
        there = np.concatenate([head, v])
        n = 1 << int(np.ceil(np.log2(len(there) + len(v))))
        # sum over t of v[t] * there[t + len(head) - lag]
        both = np.fft.irfft(np.fft.rfft(v, n) * np.conj(np.fft.rfft(there, n)), n)
        at = np.arange(min(lags, len(there)))
        return {"sums": lists(both[(at - len(head)) % n][None, :])}

    parts = _each(with_halo(less, min(lags - 1, size), 0, size, by), by, [T.StructField("sums", NUMBERS)], work)
    sums = parts.select(*by, F.posexplode("sums").alias("lag", "ac")).groupBy(*by, "lag").agg(F.sum("ac").alias("ac"))
    most = sums.groupBy(*by).agg(F.max("ac").alias("most"))
    return sums.join(most, list(by)).where("most > 0").select(*by, "lag", (F.col("ac") / F.col("most")).alias("ac"))


#: Cells of a level that one of the next level covers, and samples of a cell of the lowest.
FAN, CELL = 16, 64


def pyramid(blocks: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",), cell: int = CELL, fan: int = FAN) -> list[DataFrame]:
    """Levels (by..., cell, low, high) of least and greatest samples: of ``cell`` samples each, then of ``fan`` cells of the level below, up to a block."""
    if size % cell:
        raise ValueError("a block must be whole cells")
    per = size // cell
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / cell).cast("int") - 1), lambda i: F.slice("v", i * cell + 1, F.lit(cell)))
    ends = F.transform(pieces, lambda p: F.struct(F.array_min(p).alias("low"), F.array_max(p).alias("high")))
    levels = [blocks.select(*by, "block", F.posexplode(ends).alias("i", "e")).select(*by, (F.col("block") * per + F.col("i")).alias("cell"), "e.low", "e.high")]
    covered = cell
    while covered * fan <= size:
        covered *= fan
        below = levels[-1].groupBy(*by, F.floor(F.col("cell") / fan).alias("cell"))
        levels.append(below.agg(F.min("low").alias("low"), F.max("high").alias("high")))
    return levels


def covering(a: int, b: int, wide: list[int]) -> list[tuple[int, int, int]]:
    """[a, b) as ranges (level, first, end) of whole cells of the levels, which cover so many samples; of level -1 single samples."""
    for k in range(len(wide) - 1, -1, -1):
        first, end = -(-a // wide[k]), b // wide[k]
        if first < end:
            return [*covering(a, first * wide[k], wide[:k]), (k, first, end), *covering(end * wide[k], b, wide[:k])]
    return [(-1, a, b)] if a < b else []


def extremes(blocks: DataFrame, levels: list[DataFrame], spans: DataFrame, size: int = SIZE, by: tuple[str, ...] = ("track",), cell: int = CELL, fan: int = FAN) -> DataFrame:
    """The spans (by..., others, a, b), half open, with low and high: their least and greatest sample.

    A span is whole cells of the highest level that fit, then of each level below at its two ends, and
    samples of at most two cells; so it meets a few cells of each level, however long it is.
    """
    others = [c for c in spans.columns if c not in by]
    keys, wide = spans.select(*by, *others), [cell * fan**k for k in range(len(levels))]
    schema = T.StructType([*keys.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_level", "_x", "_y"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [(i, *p) for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)) for p in covering(x, y, wide)]
            of = pa.array([p[0] for p in pieces], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns), *(pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2, 3))], names=schema.names)

    held = keys.mapInArrow(run, schema)
    # the ends within cells of the lowest level come from the samples of one or two blocks
    raw = held.where("_level < 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("_x") / size), F.floor((F.col("_y") - 1) / size))))
    x, y = (F.least(F.greatest(F.col(c) - F.col("block") * size, F.lit(0)), F.lit(size)).cast("int") for c in ("_x", "_y"))
    piece = F.slice("v", x + 1, y - x)
    parts = [raw.join(blocks, [*by, "block"]).select(*by, *others, F.array_min(piece).alias("low"), F.array_max(piece).alias("high"))]
    for k, level in enumerate(levels):
        cells = held.where(F.col("_level") == k).select(*by, *others, F.explode(F.sequence("_x", F.col("_y") - 1)).alias("cell"))
        parts.append(cells.join(level, [*by, "cell"]).select(*by, *others, "low", "high"))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy(*by, *others).agg(F.min("low").alias("low"), F.max("high").alias("high"))
