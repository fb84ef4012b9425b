"""Separation: masks, low rank and sparse parts, stems, chunk plans, models run by chunk, overlap-add and passes with a shift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import scalars as S
from . import blocks
from .transform import NUMBERS, context_frames, lists, magnitudes, masked, rows

#: The stems of each method, in order (fixed values).
STEMS = {"hpss": ("harmonic", "percussive"), "combined": ("harmonic", "percussive"), "rpca": ("lowrank", "sparse"), "demucs_4": ("drums", "bass", "other", "vocals"), "demucs_6": ("drums", "bass", "other", "vocals", "guitar", "piano")}
#: Extra passes of each quality (fixed values).
SHIFTS = {"fast": 0, "balanced": 1, "best": 2}


def shifts(quality: str) -> int:
    if quality not in SHIFTS:
        raise ValueError(f"quality {quality!r} is none of {sorted(SHIFTS)}")
    return SHIFTS[quality]


def pulled_back(total: Column, chunk: int, overlap: int) -> Column:
    """Structs (start, end) of windows of one length; the last is pulled back to end with the whole."""
    if not 0 <= overlap < chunk:
        raise ValueError("the overlap must be at least 0 and below the chunk")
    hop = chunk - overlap
    n = F.ceil((total - chunk) / hop) + 1
    start = lambda i: F.least(i * hop, total - chunk)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(start(i).alias("start"), (start(i) + chunk).alias("end")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), total.cast("long").alias("end")))
    return F.when(total <= 0, F.slice(one, 1, 0)).when(total <= chunk, one).otherwise(many)


def clipped(total: Column, chunk: int, overlap: int) -> Column:
    """Structs (start, end) of windows that begin at every chunk - overlap below the total; what passes the end is cut off."""
    if not 1 <= overlap < chunk:
        raise ValueError("the overlap must be at least 1 and below the chunk")
    hop = chunk - overlap
    last = F.ceil(F.greatest(total, F.lit(1)) / hop) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct((i * hop).alias("start"), F.least(i * hop + chunk, total).alias("end")))


def faded(total: Column, chunk: int, overlap: int) -> Column:
    """By how many rows each of the windows of ``clipped`` is cross-faded with the one before; start and end are columns."""
    hop = chunk - overlap
    before = F.least(F.col("start") - hop + chunk, total) - (F.col("start") - hop)
    own = F.least(F.col("start") + hop, total) - F.col("start")
    return F.when(F.col("start") == 0, 0).otherwise(F.least(F.lit(overlap), F.col("end") - F.col("start"), before, own))


def chunks(sizes: DataFrame, plan: Column) -> DataFrame:
    """(track, chunk, start, end)"""
    return sizes.select("track", F.posexplode(plan).alias("chunk", "w")).select("track", "chunk", "w.start", "w.end")


def blended(parts: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, n, v) from rows (by, n, start, end, y): overlapping chunks, weighted by a Hann window that is nowhere zero."""
    w = S.hann_centred(F.col("n") - F.col("start"), F.col("end") - F.col("start"))
    added = parts.groupBy(*by, "n").agg(F.sum(w * F.col("y")).alias("y"), F.sum(w).alias("w"))
    return added.select(*by, "n", (F.col("y") / F.greatest(F.col("w"), F.lit(1e-30))).alias("v"))


def spread(signal: DataFrame, plan: DataFrame, chunk: int) -> DataFrame:
    """(track, n, v) with the columns of the plan: the samples of each chunk, found by the blocks of the chunk's length that it touches."""
    block = F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk)))
    held = plan.withColumn("block", block)
    return signal.withColumn("block", F.floor(F.col("n") / chunk)).join(held, ["track", "block"]).where((F.col("n") >= F.col("start")) & (F.col("n") < F.col("end"))).drop("block")


def shifted_mean(signal: DataFrame, sizes: DataFrame, passes: int, infer) -> DataFrame:
    """(track, n, v): the mean over passes that roll the signal by a share of its length, infer, and roll back; infer(v, place) is a Column."""
    held = signal.join(sizes, "track").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    by = F.floor(F.col("samples") * F.col("pass") / passes)
    place = F.pmod(F.col("n") - by, F.col("samples"))
    return held.withColumn("y", infer(F.col("v"), place)).groupBy("track", "n").agg(F.avg("y").alias("v"))


def _without(matrix: np.ndarray, by: float) -> np.ndarray:
    """The matrix with its singular values less ``by``, none below 0, from the eigenvectors of the smaller Gram matrix."""
    wide = matrix.shape[0] <= matrix.shape[1]
    squares, vectors = np.linalg.eigh(matrix @ matrix.T if wide else matrix.T @ matrix)
    singular = np.sqrt(np.maximum(squares, 0))
    held = singular > by
    vectors, share = vectors[:, held], 1 - by / singular[held]
    return (vectors * share) @ (vectors.T @ matrix) if wide else ((matrix @ vectors) * share) @ vectors.T


def low_rank(matrix: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts of a matrix.

    Principal component pursuit by the augmented Lagrangian method with inexact steps (Lin, Chen and Ma):
    the multiplier begins at the matrix over its dual norm, and the penalty grows by half in each round.
    What is left falls to the tolerance in some 27 to 32 rounds, so ``rounds`` is a bound only.  A tolerance of 5e-4
    would do with 15 to 20, but moves single cells of a mask by up to 0.9 (by 0.005 in the mean); 1e-6 moves none by over 0.05.
    """
    whole = np.linalg.norm(matrix)
    if whole == 0:
        return np.zeros_like(matrix), np.zeros_like(matrix)
    balance = 1 / np.sqrt(max(matrix.shape))
    widest = np.linalg.norm(matrix, 2)
    multiplier, penalty = matrix / max(widest, np.abs(matrix).max() / balance), 1.25 / widest
    low = np.zeros_like(matrix)
    for _ in range(rounds):
        aim = matrix + multiplier / penalty
        sparse = aim - low
        sparse = sparse - np.clip(sparse, -balance / penalty, balance / penalty)
        low = _without(aim - sparse, 1 / penalty)
        rest = matrix - low - sparse
        if np.linalg.norm(rest) <= tolerance * whole:
            break
        multiplier, penalty = multiplier + penalty * rest, 1.5 * penalty
    return low, sparse


def low_rank_chunks(frames: DataFrame, chunk: int = 400, overlap: int = 80) -> DataFrame:
    """(track, frame, low, sparse), arrays: each chunk of frames on its own, cross-faded where one takes over from the one before."""
    sizes = frames.groupBy("track").agg((F.max("frame") + 1).alias("total"))
    hop = chunk - overlap
    plan = chunks(sizes, clipped(F.col("total"), chunk, overlap)).join(sizes, "track").withColumn("fade", faded(F.col("total"), chunk, overlap))
    after = plan.select("track", (F.col("chunk") - 1).alias("chunk"), F.col("fade").alias("next_fade"))
    plan = plan.join(after, ["track", "chunk"], "left").select("track", "chunk", "start", "end", "fade", F.coalesce("next_fade", F.lit(0)).alias("next_fade"))
    held = spread(frames.select("track", F.col("frame").alias("n"), F.col("m").alias("v")), plan, chunk)

    def split(part: pa.Table) -> pa.Table:
        part = part.sort_by("n")
        n, start = part.column("n").to_numpy(), part.column("start")[0].as_py()
        fade, after = part.column("fade")[0].as_py(), part.column("next_fade")[0].as_py()
        parts = low_rank(rows(part.column("v")))
        # rising within the own fade, falling within that of the next chunk, which begins a hop on
        place = n - start
        weight = np.where(place < fade, (place + 1) / (fade + 1), 1.0)
        weight = np.where(place >= hop, np.where(place - hop < after, 1 - (place - hop + 1) / (after + 1), 0.0), weight)
        used = np.flatnonzero(weight > 0)
        low, sparse = (lists(x[used] * weight[used, None]) for x in parts)
        return pa.table({"track": part.column("track").take(pa.array(used)), "n": n[used], "low": low, "sparse": sparse})

    schema = held.select("track", "n", F.col("v").alias("low"), F.col("v").alias("sparse")).schema
    parts = held.groupBy("track", "chunk").applyInArrow(split, schema)
    # a frame has one row, or two where chunks meet
    both = parts.groupBy("track", F.col("n").alias("frame")).agg(F.collect_list("low").alias("low"), F.collect_list("sparse").alias("sparse"))
    added = lambda c: F.aggregate(F.slice(c, 2, 8), F.element_at(c, 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return both.select("track", "frame", added("low").alias("low"), added("sparse").alias("sparse"))


def medians(frames: DataFrame, time: int = 31, freq: int = 31, block: int = 256) -> DataFrame:
    """(track, frame, m, h, p), arrays: magnitudes with their medians along time and along frequency, zeros beyond the edges.

    A block of frames takes along half a window of frames on both sides.
    """
    half, side = context_frames(time), context_frames(freq)
    touched = F.explode(F.sequence(F.floor(F.greatest(F.col("frame") - half, F.lit(0)) / block), F.floor((F.col("frame") + half) / block))).alias("block")
    held = frames.select("track", "frame", "m", touched)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("frame")
        first, frame, m = part.column("block")[0].as_py() * block, part.column("frame").to_numpy(), rows(part.column("m"))
        own = np.flatnonzero((frame >= first) & (frame < first + block))
        padded = np.zeros((block + 2 * half, m.shape[1]))
        padded[frame - first + half] = m
        span = int(frame[own[-1]]) - first + 1 if len(own) else 0
        h = np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(padded[: span + 2 * half, a : a + 256], time, axis=0), axis=2) for a in range(0, m.shape[1], 256)], axis=1) if span else padded[:0]
        across = np.pad(m[own], ((0, 0), (side, side)))
        p = np.concatenate([np.median(np.lib.stride_tricks.sliding_window_view(across[a : a + 16], freq, axis=1), axis=2) for a in range(0, len(own), 16)]) if span else padded[:0]
        return pa.table({"track": part.column("track").take(pa.array(own)), "frame": frame[own], "m": lists(m[own]), "h": lists(h[frame[own] - first]), "p": lists(p)})

    schema = frames.select("track", "frame", F.col("m").cast("array<double>").alias("m")).schema.add("h", NUMBERS).add("p", NUMBERS)
    return held.groupBy("track", "block").applyInArrow(run, schema)


def median_masks(frames: DataFrame, time: int = 31, freq: int = 31) -> DataFrame:
    """(track, frame, harmonic, percussive), arrays"""
    held = medians(frames, time, freq)
    return held.select("track", "frame", F.zip_with("h", "p", lambda a, b: S.wiener(a, b)).alias("harmonic"), F.zip_with("p", "h", lambda a, b: S.wiener(a, b)).alias("percussive"))


def low_rank_masks(frames: DataFrame, chunk: int = 400, overlap: int = 80) -> DataFrame:
    """(track, frame, lowrank, sparse), arrays"""
    held = low_rank_chunks(frames, chunk, overlap)
    return held.select("track", "frame", F.zip_with("low", "sparse", lambda a, b: S.wiener(a, b)).alias("lowrank"), F.zip_with("sparse", "low", lambda a, b: S.wiener(a, b)).alias("sparse"))


def combined_masks(frames: DataFrame, time: int = 31, freq: int = 31, chunk: int = 400, overlap: int = 80) -> DataFrame:
    """(track, frame, harmonic, percussive), arrays: geometric means of both kinds of masks, over their sum."""
    both = median_masks(frames, time, freq).join(low_rank_masks(frames, chunk, overlap), ["track", "frame"])
    mean = lambda a, b: F.zip_with(a, b, lambda x, y: F.sqrt(x * y))
    held = both.select("track", "frame", mean("harmonic", "lowrank").alias("a"), mean("percussive", "sparse").alias("b"))
    share = lambda a, b: F.zip_with(a, b, lambda x, y: x / (x + y + 1e-10))
    return held.select("track", "frame", share("a", "b").alias("harmonic"), share("b", "a").alias("percussive"))


def stems_of(method: str) -> tuple[str, ...]:
    if method not in STEMS:
        raise ValueError(f"method {method!r} is none of {sorted(STEMS)}")
    return STEMS[method]


def separate(signal: DataFrame, method: str, win: int, hop: int | None = None, size: int = blocks.SIZE, **sizes) -> DataFrame:
    """(track, stem, n, v): the stems of separate_blocks() of a signal with a row for each sample."""
    by = ("track", "stem")
    return blocks.samples(separate_blocks(blocks.to_blocks(signal, size), method, win, hop, size, **sizes), size, by)


def separate_blocks(held: DataFrame, method: str, win: int, hop: int | None = None, size: int = blocks.SIZE, **sizes) -> DataFrame:
    """(track, stem, block, v): the transform of a signal's blocks under each stem's mask, back as blocks; the stems of a track add up to it.

    sizes: those that the method's masks take.
    """
    makers = {"hpss": median_masks, "rpca": low_rank_masks, "combined": combined_masks}
    stems = stems_of(method)
    if method not in makers:
        raise ValueError(f"method {method!r} needs a model: see infer_chunks")
    spectra = blocks.stft(held, win, hop, size)
    parts = masked(spectra, makers[method](magnitudes(spectra), **sizes), stems)
    return blocks.istft(parts, blocks.lengths(held, size), win, hop, size, by=("track", "stem"))


def infer_blocks(held: DataFrame, plan: DataFrame, chunk: int, infer, stems: tuple[str, ...], size: int = blocks.SIZE) -> DataFrame:
    """(track, chunk, start, end, stem, y), y an array: a model run on each chunk of the plan, whole and in order.

    A chunk shorter than the model's is padded with zeros, and the output cut back.  A model that gives
    fewer stems than are named is an error.
    """

    def work(x: np.ndarray, row: dict) -> dict:
        found = normalised_output(infer(np.concatenate([x, np.zeros(max(0, chunk - len(x)))])), len(x))
        if missing := stems[len(found) :]:
            raise ValueError(f"the model's output lacks the stems {', '.join(missing)}")
        return {"stem": pa.array(stems), "y": lists(found[: len(stems)])}

    return blocks.chunked(held, plan, work, [T.StructField("stem", T.StringType()), T.StructField("y", NUMBERS)], size)


def separate_by_model(held: DataFrame, rate: int, model_rate: int, chunk: int, overlap: int, infer, stems: tuple[str, ...], passes: int = 1, size: int = blocks.SIZE) -> DataFrame:
    """(track, stem, block, v) at the signal's own rate and length: resampled to the model's, run in overlapping chunks,
    blended, the mean of passes that begin at different places, and resampled back."""
    by = ("track", "stem")
    inner = blocks.resampled(held, model_rate, rate, size)
    lengths = blocks.lengths(inner, size)
    each = inner.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))) if passes > 1 else inner.withColumn("pass", F.lit(0))
    named = each.select(F.struct("track", "pass").alias("track"), "block", "v")
    sizes = lengths.select("track", "samples", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    sizes = sizes.select(F.struct("track", "pass").alias("track"), "samples", F.floor(F.col("samples") * F.col("pass") / passes).alias("by"))
    rolled = blocks.rolled(named, sizes.select("track", "samples", "by"), size)
    plan = chunks(sizes.select("track", F.col("samples").alias("total")), pulled_back(F.col("total"), chunk, overlap))
    out = blocks.blended(infer_blocks(rolled, plan, chunk, infer, stems, size), size, by)
    back = blocks.rolled(out, sizes.select("track", "samples", (-F.col("by")).alias("by")), size, by)
    mean = blocks.mean(back.select("track.track", "stem", "block", "v"), size, by)
    whole = blocks.resampled(mean, rate, model_rate, size, by)
    return blocks.cut_to(whole, blocks.lengths(held, size), size)


def normalised_output(output, samples: int) -> np.ndarray:
    """(stem, sample) of what a model gives: an array or a list of one for each stem, with or without axes of length 1 and of channels."""
    if isinstance(output, list | tuple):
        output = np.stack([np.atleast_2d(np.squeeze(np.asarray(x, float))).mean(axis=0) for x in output])
    held = np.squeeze(np.asarray(output, float))
    if held.ndim == 3:
        held = held.mean(axis=1)
    held = held.reshape(1, -1) if held.ndim == 1 else held
    if held.ndim != 2:
        raise ValueError(f"a model's output has the shape {np.shape(output)}")
    return held[:, :samples]


def infer_chunks(signal: DataFrame, plan: DataFrame, chunk: int, infer, stems: tuple[str, ...]) -> DataFrame:
    """(track, stem, n, start, end, y): a model run on each chunk of the plan, whole and in order.

    A chunk shorter than the model's is padded with zeros, and the output cut back.  A model that gives
    fewer stems than are named is an error.
    """
    held = spread(signal, plan, chunk)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("n")
        x = part.column("v").to_numpy()
        found = normalised_output(infer(np.concatenate([x, np.zeros(max(0, chunk - len(x)))])), len(x))
        if missing := stems[len(found) :]:
            raise ValueError(f"the model's output lacks the stems {', '.join(missing)}")
        place = pa.array(np.tile(np.arange(len(x)), len(stems)))
        columns = {c: part.column(c).take(place) for c in ("track", "n", "start", "end")}
        return pa.table({"track": columns["track"], "stem": np.repeat(stems, len(x)).tolist(), "n": columns["n"], "start": columns["start"], "end": columns["end"], "y": found[: len(stems)].reshape(-1)})

    schema = held.select("track").schema.add("stem", "string").add("n", "long").add("start", "long").add("end", "long").add("y", "double")
    return held.select("track", "n", "v", "chunk", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).groupBy("track", "chunk").applyInArrow(run, schema)
