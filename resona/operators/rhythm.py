"""Flux, thresholds, onsets, tempo and beats."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Tempo candidates, and those that count fully (fixed values).
BPM_LOW, BPM_HIGH, BPM_STEP, COMMON_LOW, COMMON_HIGH, UNCOMMON = 50.0, 240.0, 0.5, 70.0, 180.0, 0.7
#: Frames that a tempo needs at least, and what a track without one gets (fixed values).
LEAST_FRAMES, DEFAULT = 64, (120.0, 0.0)
#: Spread added to the moving median (fixed value).
SPREAD = 0.15


def band_bins(low_hz: float, high_hz: float, rate: int, win: int) -> tuple[int, int]:
    """[first, end) bins of a band, kept within the spectrum."""
    bins = win // 2 + 1
    return max(1, min(math.floor(low_hz * win / rate), bins - 1)), max(2, min(math.ceil(high_hz * win / rate), bins))


def flux(frames: DataFrame, first: int = 0, end: int | None = None, from_silence: bool = False) -> DataFrame:
    """(track, frame, flux): rises of the bins since the frame before; the first frame has none, or rises from silence."""
    m = F.col("m") if end is None else F.slice("m", first + 1, end - first)
    order = Window.partitionBy("track").orderBy("frame")
    held = frames.select("track", "frame", m.alias("m")).withColumn("was", F.lag("m").over(order))
    if not from_silence:
        held = held.where("was is not null")
    rise = F.zip_with("m", F.coalesce("was", F.transform("m", lambda x: F.lit(0.0))), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return held.select("track", "frame", F.aggregate(rise, F.lit(0.0), lambda s, x: s + x).alias("flux"))


def padded(series: DataFrame, order: str, value: str, half: int) -> DataFrame:
    """The series with its first and last value repeated half times before and after it."""
    ends = series.groupBy("track").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.min_by(value, order).alias("x"), F.max_by(value, order).alias("y"))
    offset = F.sequence(F.lit(1), F.lit(half))
    more = F.concat(F.transform(offset, lambda i: F.struct((F.col("a") - i).alias("o"), F.col("x").alias("v"))), F.transform(offset, lambda i: F.struct((F.col("b") + i).alias("o"), F.col("y").alias("v"))))
    pads = ends.select("track", F.explode(more).alias("e")).select("track", F.col("e.o").alias(order), F.col("e.v").alias(value), F.lit(True).alias("_pad"))
    return series.select("track", order, value, F.lit(False).alias("_pad")).union(pads)


def thresholds(series: DataFrame, half: int, spread: float = SPREAD) -> DataFrame:
    """(track, frame, flux, threshold): moving median and deviation around each frame, ends repeated."""
    near = Window.partitionBy("track").orderBy("frame").rowsBetween(-half, half)
    held = padded(series, "frame", "flux", half)
    mean, square = F.avg("flux").over(near), F.avg(F.col("flux") * F.col("flux")).over(near)
    level = F.percentile("flux", F.lit(0.5)).over(near) + spread * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return held.withColumn("threshold", level).where("not _pad").drop("_pad")


def peaks(series: DataFrame, half: int) -> DataFrame:
    """The series with ``peak``: not below what half frames before have nor equal to any after; never at an end."""
    order = Window.partitionBy("track").orderBy("frame")
    before = F.greatest(F.coalesce(F.max("flux").over(order.rowsBetween(-half, -1)), F.lit(0.0)), F.lit(0.0))
    after = F.greatest(F.coalesce(F.max("flux").over(order.rowsBetween(1, half)), F.lit(0.0)), F.lit(0.0))
    inner = F.lag("frame").over(order).isNotNull() & F.lead("frame").over(order).isNotNull()
    return series.withColumn("peak", inner & (F.col("flux") >= before) & (F.col("flux") > after))


def thin(candidates: DataFrame, gap: int) -> DataFrame:
    """(track, frame): from the left, those at least ``gap`` after the last one kept.

    A candidate that far behind the one before is kept whatever came earlier, so each island of closer
    ones is worked out on its own.
    """
    by = Window.partitionBy("track").orderBy("frame")
    opens = F.coalesce((F.col("frame") - F.lag("frame").over(by) >= gap).cast("int"), F.lit(1))
    islands = candidates.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(by))
    empty = F.struct(F.lit(None).cast("bigint").alias("last"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    step = lambda held, f: F.when(held["last"].isNull() | (f - held["last"] >= gap), F.struct(f.alias("last"), F.array_append(held["kept"], f).alias("kept"))).otherwise(held)
    kept = F.aggregate(F.array_sort(F.collect_list(F.col("frame").cast("bigint"))), empty, step, lambda held: held["kept"])
    return islands.groupBy("track", "_island").agg(kept.alias("kept")).select("track", F.explode("kept").alias("frame"))


def onsets(frames: DataFrame, first: int, end: int, half: int, near: int, gap: int) -> DataFrame:
    """(track, frame) of the onsets: flux peaks above their threshold that are not too close."""
    found = peaks(thresholds(flux(frames, first, end, from_silence=True), half), near)
    return thin(found.where("peak and flux > threshold").select("track", F.col("frame").cast("long").alias("frame")), gap)


def autocorrelation(series: DataFrame, lags: int, t: str = "t", x: str = "x") -> DataFrame:
    """(track, lag, ac): sums of products of the demeaned series, t without gaps, with itself, lag steps on, over the greatest of them.

    By transforms of blocks of the series, so the cost does not depend on the number of lags.
    """
    from . import blocks

    size = max(blocks.SIZE, 1 << max(0, lags - 1).bit_length())
    held = blocks.to_blocks(series.select("track", F.col(t).alias("n"), F.col(x).cast("double").alias("v")), size)
    return blocks.correlated(held, lags, size)


def interpolated(points: DataFrame, at: str, values: DataFrame, index: str, value: str, last: DataFrame) -> DataFrame:
    """The points with ``value`` between the neighbours at a fractional index, held at the ends; last: (track, last)."""
    held = points.join(last, "track").withColumn("_at", F.least(F.greatest(F.col(at), F.lit(0.0)), F.col("last").cast("double")))
    low, high = (values.select("track", F.col(index).cast("long").alias(f"_{n}"), F.col(value).alias(f"_{n}v")) for n in ("low", "high"))
    held = held.withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at"))
    joined = held.join(low, ["track", "_low"]).join(high, ["track", "_high"])
    return joined.withColumn(value, F.col("_lowv") + (F.col("_highv") - F.col("_lowv")) * (F.col("_at") - F.col("_low"))).drop("_at", "_low", "_high", "_lowv", "_highv", "last")


def tempo(correlation: DataFrame, hop: float) -> DataFrame:
    """(track, bpm, score): the candidate whose lag correlates most, uncommon ones counting less; the first of equals."""
    n = int((BPM_HIGH - BPM_LOW) / BPM_STEP)
    bpm = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: BPM_LOW + i * BPM_STEP)).alias("bpm")
    last = correlation.groupBy("track").agg(F.max("lag").alias("last"))
    points = last.select("track", bpm).withColumn("lags", 60.0 / F.col("bpm") / hop)
    held = interpolated(points, "lags", correlation, "lag", "ac", last)
    score = F.col("ac") * F.when(F.col("bpm").between(COMMON_LOW, COMMON_HIGH), 1.0).otherwise(UNCOMMON)
    best = held.groupBy("track").agg(F.max(F.struct(F.bround(score, 9).alias("score"), (-F.col("bpm")).alias("less"))).alias("b"))
    return best.select("track", (-F.col("b.less")).alias("bpm"), F.col("b.score").alias("score"))


def phase(series: DataFrame, tempos: DataFrame, hop: float, t: str = "t", x: str = "x") -> DataFrame:
    """(track, bpm, offset): where a comb of pulses at the tempo gathers most of the demeaned series."""
    ends = series.groupBy("track").agg(F.avg(x).alias("mean"), F.max(t).alias("last"))
    period = 60.0 / F.col("bpm") / hop
    held = tempos.join(ends, "track").withColumn("period", period).withColumn("step", F.greatest(F.col("period") / 48, F.lit(0.5)))
    phases = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("period") / F.col("step")).cast("int") - 1))).withColumn("phase", F.col("k") * F.col("step")).where("phase < period")
    n = F.floor((F.col("last") + 1 - F.col("phase")) / F.col("period")).cast("int")
    pulses = phases.where(n >= 1).select("track", "bpm", "phase", "mean", "k", F.explode(F.sequence(F.lit(0), n - 1)).alias("pulse"), "period").withColumn("at", F.col("phase") + F.col("pulse") * F.col("period"))
    found = interpolated(pulses, "at", series, t, x, ends.select("track", "last"))
    scores = found.groupBy("track", "bpm", "k", "phase").agg(F.bround(F.sum(F.col(x) - F.col("mean")), 9).alias("score"))
    best = scores.groupBy("track", "bpm").agg(F.max_by("phase", F.struct("score", -F.col("k"))).alias("phase"))
    return best.select("track", F.bround("bpm", 1).alias("bpm"), F.bround(F.col("phase") * hop, 3).alias("offset"))


def numbered(df: DataFrame, by: str, order: tuple[str, ...], name: str = "k") -> DataFrame:
    """The rows with their place, from 1, within a key and order that together are unique.

    Rows are sorted by ranges of key and order, so a key with most of them lies in many tasks; a row's
    place is that within its range and the number of rows of its key in the ranges before.
    """
    held = df.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id())
    held = cut(held).withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    # one row for each range and each key in it
    counts = held.groupBy(by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = held.withColumnRenamed(by, "_key").join(counts.withColumnRenamed("_range", "_r"), F.col("_key").eqNullSafe(F.col(by)) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def smoothed(series: DataFrame, t: str, x: str, keep: float, block: int = 4096) -> DataFrame:
    """The series, t from 1 without gaps, with ``smooth``: keep times the last smooth value and the rest of the new one; the first is itself.

    Blocks fold on their own from 0.  What a block begins with is then known from the few rows of
    block ends, folded in order, and fades by keep with each step into the block.
    """
    place = F.floor((F.col(t) - 1) / block)
    own = F.when(F.col(t) == 1, F.col(x)).otherwise(round(1 - keep, 12) * F.col(x))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_t")
        out, last = np.empty(len(part)), 0.0
        for i, v in enumerate(part.column("_own").to_numpy().tolist()):
            out[i] = last = keep * last + v
        return part.append_column("_part", pa.array(out)).append_column("_step", pa.array(np.arange(1, len(part) + 1))).drop_columns(["_own", "_t"])

    held = series.withColumns({"_block": place, "_own": own.cast("double"), "_t": F.col(t).cast("long")})
    schema = held.drop("_own", "_t").schema.add("_part", "double").add("_step", "long")
    parts = held.groupBy("track", "_block").applyInArrow(run, schema)
    ends = parts.groupBy("track", "_block").agg(F.max_by("_part", "_step").alias("_end"), F.max("_step").alias("_size"))

    def carry(part: pa.Table) -> pa.Table:
        part = part.sort_by("_block")
        out, last = [], 0.0
        for end, size in zip(part.column("_end").to_pylist(), part.column("_size").to_pylist(), strict=True):
            out.append(last)
            last = end + last * keep**size
        return part.select(["track", "_block"]).append_column("_begin", pa.array(out, pa.float64()))

    # one row a block, so a group is a few thousandths of a track
    begins = ends.groupBy("track").applyInArrow(carry, ends.select("track", "_block").schema.add("_begin", "double"))
    return parts.join(begins, ["track", "_block"]).withColumn("smooth", F.col("_part") + F.col("_begin") * F.pow(F.lit(keep), F.col("_step"))).drop("_block", "_part", "_step", "_begin")


def estimate(series: DataFrame, hop: float, t: str = "t", x: str = "x") -> DataFrame:
    """(track, bpm, offset) of every track: tempo and phase of a series of rises, (120.0, 0.0) where it is too short or nothing rises."""
    sizes = series.groupBy("track").agg(F.count("*").alias("_n"), F.max(x).alias("_top"))
    fit = sizes.where((F.col("_n") >= LEAST_FRAMES) & (F.col("_top") > 0))
    held = series.join(fit.select("track"), "track", "left_semi")
    lags = math.ceil(60.0 / BPM_LOW / hop) + 1
    # lags of half a series and more are not looked at
    found = autocorrelation(held, lags, t, x).join(fit, "track").where(F.col("lag") < F.floor(F.col("_n") / 2)).select("track", "lag", "ac")
    beat = phase(held, tempo(found, hop), hop, t, x)
    given = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c)
    return sizes.select("track").join(beat, "track", "left").select("track", given("bpm", DEFAULT[0]), given("offset", DEFAULT[1]))


def beats(tempos: DataFrame, spans: DataFrame, beats_per_bar: int = 4) -> DataFrame:
    """(track, ms, bar): bar lines and inner beats in milliseconds within [0, span]; spans: (track, span)."""
    bar = 60000.0 / F.col("bpm") * beats_per_bar
    first = F.expr("pmod(offset * 1000, bar)")
    held = tempos.join(spans, "track").withColumn("bar", bar).withColumn("first", first).withColumn("beat", F.col("bar") / beats_per_bar)
    low = -F.floor(F.col("first") / F.col("beat")).cast("long")
    rows = held.withColumn("k", F.explode(F.sequence(low, F.floor((F.col("span") - F.col("first")) / F.col("beat")).cast("long"))))
    return rows.select("track", F.bround(F.col("first") + F.col("k") * F.col("beat"), 6).alias("ms"), (F.pmod(F.col("k"), F.lit(beats_per_bar)) == 0).alias("bar"))
