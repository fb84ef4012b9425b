"""Notes as intervals: salience, decoding, segments, merging, snapping, matching, views and event tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .spectral import hz
from .transform import rows


@dataclass(frozen=True)
class Preset:
    """What a kind of track is decoded with; costs of changes are per second."""

    low: int
    high: int
    band: tuple[float, float]
    harmonics: int
    suppression: float
    pitch_cost: float
    octave_cost: float
    rest_in: float
    rest_out: float
    rest_stay: float = 0.3
    rest_emission: float = 0.55
    least_gap: float = 0.09
    least_note: float = 0.10


#: The two presets (fixed values).
PRESETS = {
    "bass": Preset(28, 67, (30.0, 250.0), 10, 0.6, 0.8, 1.5, 2.0, 2.0, least_gap=0.09),
    "lead": Preset(48, 84, (200.0, 4000.0), 5, 0.5, 1.2, 3.0, 2.5, 2.5, least_gap=0.08),
}
#: Longest gap that mono and poly merging close, least note of poly, frames that a snap moves (fixed values).
MONO_GAP, POLY_GAP, POLY_LEAST, SNAP = 0.06, 0.05, 0.03, 1


def salience(frames: DataFrame, preset: Preset, rate: int, win: int) -> DataFrame:
    """(track, frame, s): for each pitch of the preset, the means around its harmonics' bins over their numbers, less a share of the same an octave below."""
    bins = win // 2 + 1
    sums = []
    for pitch in range(preset.low - 12, preset.high + 1):
        terms = [(min(max(int(np.rint(k * hz(pitch) * win / rate)), 1), bins - 2), k) for k in range(1, preset.harmonics + 1) if k * hz(pitch) < rate / 2]
        sums.append(F.array(*(F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in terms)) if terms else F.expr("cast(array() as array<struct<b:int,k:int>>)"))
    mean3 = lambda b: (F.element_at("m", b) + F.element_at("m", b + 1) + F.element_at("m", b + 2)) / 3.0
    raw = F.transform(F.array(*sums), lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + mean3(x["b"]) / x["k"]))
    n = preset.high - preset.low + 1
    held = frames.withColumn("_e", raw)
    s = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.greatest(F.element_at("_e", i + 12) - preset.suppression * F.element_at("_e", i), F.lit(0.0)))
    return held.select("track", "frame", s.alias("s"))


def normalised(salient: DataFrame) -> DataFrame:
    """The salience of each track brought to [0, 1]; all 0 where it has one value only."""
    span = salient.groupBy("track").agg(F.min(F.array_min("s")).alias("low"), F.max(F.array_max("s")).alias("high"))
    scaled = F.transform("s", lambda x: F.when(F.col("high") > F.col("low"), F.try_divide(x - F.col("low"), F.col("high") - F.col("low"))).otherwise(0.0))
    return salient.join(span, "track").select("track", "frame", scaled.alias("s"))


def transition_costs(n: int, hop: float, preset: Preset) -> np.ndarray:
    """Costs from a state to another; the last state is the rest."""
    step = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    octave = (step >= 12) & (step % 12 == 0)
    cost = np.full((n + 1, n + 1), 0.0)
    cost[:n, :n] = np.where(octave, preset.octave_cost * (step // 12), preset.pitch_cost * step)
    cost[n, :n], cost[:n, n], cost[n, n] = preset.rest_in, preset.rest_out, preset.rest_stay
    return cost * hop


def decode(salient: DataFrame, hop: float, preset: Preset) -> DataFrame:
    """(track, frame, state): the cheapest path through pitches and rest, the lowest state of equals.

    The frames of a track stream by in order.  Whatever frames lie behind the point where the paths to
    all states become one are settled and handed on, so a task holds only the frames after it.
    """
    n = preset.high - preset.low + 1
    cost = transition_costs(n, hop, preset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, total, open_ = None, None, []  # open_: (frame, the best state before each state)

        def settled(states: np.ndarray) -> pa.RecordBatch:
            """The open frames but the first of the next batch, along the path that ends in the last of these states."""
            frames = [f for f, _ in open_[: len(states)]]
            tracks = pa.array([track] * len(frames), kind)
            return pa.RecordBatch.from_arrays([tracks, pa.array(frames, pa.int64()), pa.array(states, pa.int32())], names=["track", "frame", "state"])

        def back(state: int, upto: int) -> np.ndarray:
            states = np.empty(upto + 1, np.int32)
            states[upto] = state
            for f in range(upto, 0, -1):
                states[f - 1] = open_[f][1][states[f]]
            return states

        for batch in batches:
            kind = batch.schema.field("track").type
            for name, frame, s in zip(batch.column("track").to_pylist(), batch.column("frame").to_pylist(), rows(pa.chunked_array([batch.column("s")])), strict=True):
                emission = np.append(1.0 - s, preset.rest_emission)
                if name != track or total is None:
                    if open_:
                        yield settled(back(int(total.argmin()), len(open_) - 1))
                    track, total, open_ = name, emission, [(frame, None)]
                    continue
                through = total[:, None] + cost
                best = through.argmin(axis=0)
                total = through[best, np.arange(n + 1)] + emission
                open_.append((frame, best.astype(np.int32)))
            # where all paths are one
            at, states = len(open_) - 1, np.arange(n + 1)
            while at > 0 and (states != states[0]).any():
                states, at = open_[at][1][states], at - 1
            if at > 0:
                done = back(int(states[0]), at)
                yield settled(done[:-1])
                open_ = open_[at:]
        if open_:
            yield settled(back(int(total.argmin()), len(open_) - 1))

    schema = salient.select("track", F.col("frame").cast("long").alias("frame")).schema.add("state", "integer")
    held = salient.select("track", F.col("frame").cast("long").alias("frame"), "s")
    return held.repartition("track").sortWithinPartitions("track", "frame").mapInArrow(run, schema)


def runs(states: DataFrame, rest=None, state: str = "state", order: str = "frame") -> DataFrame:
    """(track, state, f0, f1): maximal runs of one state, half open, those at rest left out."""
    by = Window.partitionBy("track").orderBy(order)
    held = states.withColumn("_new", F.coalesce((F.col(state) != F.lag(state).over(by)).cast("int"), F.lit(1)))
    held = held.withColumn("_run", F.sum("_new").over(by))
    out = held.groupBy("track", "_run").agg(F.first(state).alias("state"), F.min(order).alias("f0"), (F.max(order) + 1).alias("f1")).drop("_run")
    return out if rest is None else out.where(F.col("state") != F.lit(rest))


def merge_mono(segments: DataFrame, hop: float, gap: float = MONO_GAP) -> DataFrame:
    """Segments joined to the one just before, of whatever pitch, if it has the same and the gap is at most that."""
    by = Window.partitionBy("track").orderBy("f0")
    near = (F.col("state") == F.lag("state").over(by)) & ((F.col("f0") - F.lag("f1").over(by)) * hop <= gap + 1e-9)
    held = segments.withColumn("_island", F.sum((~F.coalesce(near, F.lit(False))).cast("int")).over(by))
    return held.groupBy("track", "_island").agg(F.first("state").alias("state"), F.min("f0").alias("f0"), F.max("f1").alias("f1")).drop("_island")


def merge_poly(notes: DataFrame, gap: float = POLY_GAP, least: float = POLY_LEAST) -> DataFrame:
    """(track, pitch, start, end, conf): notes of one pitch joined while the next begins less than the gap after all before end."""
    by = Window.partitionBy("track", "pitch").orderBy("start", "id")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    held = notes.withColumn("_island", F.sum(F.coalesce((F.col("start") - reach >= gap).cast("int"), F.lit(1))).over(by))
    out = held.groupBy("track", "pitch", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("conf").alias("conf"))
    return out.where(F.col("end") - F.col("start") >= least).drop("_island")


def snapped(points: DataFrame, onsets: DataFrame, by: int = SNAP, columns: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The points with ``snapped`` (several columns: with each name and _snapped): the first onset within so many frames, else the frame itself."""
    near = onsets.select("track", F.col("frame").alias("_o"), F.explode(F.sequence(F.col("frame") - by, F.col("frame") + by)).alias("_at"))
    hits = near.groupBy("track", "_at").agg(F.min("_o").alias("_hit"))
    for column in columns:
        named = hits.select("track", F.col("_at").alias(column), "_hit")
        name = "snapped" if columns == ("frame",) else f"{column}_snapped"
        points = points.join(named, ["track", column], "left").withColumn(name, F.coalesce("_hit", column)).drop("_hit")
    return points


def confidences(segments: DataFrame, salient: DataFrame, low: int = 0) -> DataFrame:
    """The segments with ``conf``, the mean salience of their pitch over their frames; state indexes the salience array.

    Segments are told apart by all of their columns, so an id keeps two of equal bounds apart.
    """
    frame = F.explode(F.sequence("f0", F.greatest(F.col("f1"), F.col("f0") + 1) - 1)).alias("frame")
    held = segments.select("*", frame).join(salient, ["track", "frame"])
    return held.groupBy(*segments.columns).agg(F.bround(S.clamp(F.avg(F.element_at("s", F.col("state") - low + 1)), 0.0, 1.0), 4).alias("conf"))


def mono_notes(frames: DataFrame, onsets: DataFrame, preset: Preset, rate: int, win: int, hop: float) -> DataFrame:
    """(track, pitch, start, end, conf): salience, decoding, segments, merging, snapping and confidence of a track."""
    scaled = normalised(salience(frames, preset, rate, win))
    n = preset.high - preset.low + 1
    held = snapped(merge_mono(runs(decode(scaled, hop, preset), rest=n), hop), onsets, columns=("f0", "f1"))
    # the bounds before snapping tell apart what snaps to the same ones
    held = held.select("track", "state", F.struct("f0", "f1").alias("id"), F.col("f0_snapped").alias("f0"), F.col("f1_snapped").alias("f1"))
    named = confidences(held.where((F.col("f1") - F.col("f0")) * hop >= preset.least_note), scaled)
    return named.select("track", (F.col("state") + preset.low).alias("pitch"), F.bround(F.col("f0") * hop, 4).alias("start"), F.bround(F.col("f1") * hop, 4).alias("end"), "conf")


def presets(spark: SparkSession) -> DataFrame:
    """(name, low, high, band_low, band_high, harmonics, least_note): the presets as a dimension."""
    held = [(name, p.low, p.high, *p.band, p.harmonics, p.least_note) for name, p in PRESETS.items()]
    return spark.createDataFrame(held, "name string, low int, high int, band_low double, band_high double, harmonics int, least_note double")


def preset_of(name: str) -> Preset:
    if name not in PRESETS:
        raise KeyError(f"preset {name!r} is none of {sorted(PRESETS)}")
    return PRESETS[name]


def names_of(selection: str) -> list[str]:
    """The presets that a selection covers: one, or both of them."""
    if selection != "both":
        preset_of(selection)
    return list(PRESETS) if selection == "both" else [selection]


def selected(notes: DataFrame, selection: str, column: str = "preset") -> DataFrame:
    """The notes of one preset, or of both together."""
    return notes.where(F.col(column).isin(names_of(selection)))


def visible(notes: DataFrame, a: float, b: float, longest) -> DataFrame:
    """Notes that touch [a, b]; none is longer than ``longest``, a number or a column, so the start is bounded on both sides."""
    return notes.where((F.col("start") >= a - longest) & (F.col("start") <= b) & (F.col("end") >= a))


def most_confident(notes: DataFrame, n: int) -> DataFrame:
    return notes.orderBy(F.desc("conf"), "id").limit(n).orderBy("start", "id")


def midi_events(notes: DataFrame, bpm: float, offset: float) -> DataFrame:
    """(track, tick, kind, pitch, velocity, id): note off 0 and on 1, an off at least a tick after its on."""
    tempo = F.lit(bpm if bpm and bpm > 0 else S.DEFAULT_BPM)
    on = F.greatest(F.lit(0), S.ticks(F.col("start") - offset, tempo))
    off = F.greatest(F.lit(0), S.ticks(F.col("end") - offset, tempo), on + 1)
    both = F.array(F.struct(on.alias("tick"), F.lit(1).alias("kind"), S.velocity(F.col("conf")).alias("velocity")), F.struct(off.alias("tick"), F.lit(0).alias("kind"), F.lit(0).alias("velocity")))
    return notes.select("id", "track", "pitch", F.explode(both).alias("e")).select("track", "e.tick", "e.kind", "pitch", "e.velocity", "id")


def deltas(events: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """The events with ``delta``, ticks since the one before in its track; offs come before ons."""
    order = Window.partitionBy(*by).orderBy("tick", "kind", "id")
    return events.withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0)))


def scores(reference: DataFrame, estimate: DataFrame, matched: DataFrame) -> DataFrame:
    """(track, precision, recall, f1), 0 where there is nothing to divide by."""
    count = lambda df, name: df.groupBy("track").agg(F.count("*").alias(name))
    held = count(reference, "r").join(count(estimate, "e"), "track", "full").join(count(matched, "m"), "track", "left").na.fill(0, ["r", "e", "m"])
    p, r = (F.coalesce(F.try_divide("m", x), F.lit(0.0)) for x in ("e", "r"))
    return held.select("track", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def mean_scores(scored: DataFrame) -> DataFrame:
    """(files, precision, recall, f1): plain means over all rows of scores()."""
    return scored.agg(F.count("*").alias("files"), *(F.bround(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def predicted_notes(chunks: DataFrame, predict, gap: float = POLY_GAP, least: float = POLY_LEAST) -> DataFrame:
    """(track, pitch, start, end, conf): notes that a model finds in the samples of each chunk, merged over all chunks.

    chunks: (track, chunk, n, v, start); predict takes a chunk's samples in order and gives rows
    (pitch, start, end, conf) in samples since the chunk's start.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = part.sort_values("n")
        found = pd.DataFrame(predict(held["v"].to_numpy(float)), columns=["pitch", "start", "end", "conf"]).astype({"pitch": "int32", "start": float, "end": float, "conf": float})
        base = int(held["start"].iloc[0])
        return found.assign(track=held["track"].iloc[0], start=found["start"] + base, end=found["end"] + base)[["track", "pitch", "start", "end", "conf"]]

    schema = chunks.select("track").schema.add("pitch", "integer").add("start", "double").add("end", "double").add("conf", "double")
    raw = chunks.groupBy("track", "chunk").applyInPandas(run, schema)
    return merge_poly(raw.withColumn("id", F.xxhash64("track", "pitch", "start", "end", "conf")), gap, least)
