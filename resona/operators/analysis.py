"""The analysis of a recording: spectra of its channels on one scale, tempo, and the document that describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import blocks, rhythm, spectral, transform
from .lineage import cut

#: Rates of columns a second that can be asked for, and parts of a semitone (fixed values).
TIME_RATES, SUBS = (15, 60), (1, 5, 10)
#: Seconds that a view shows at first (fixed value).
FIRST_VIEW = 15.0
#: Digits that a level keeps before it becomes a whole step (fixed value).
DIGITS = 6


class Stages:
    """Row counts of the stages of a job, told as Spark's own metrics of the actions that run them."""

    def __init__(self) -> None:
        self._held: dict[str, Observation] = {}

    def watch(self, name: str, df: DataFrame, each: Column | int = 1) -> DataFrame:
        """The rows, counted under a name by the first action that goes through them; each: what one of them counts."""
        self._held[name] = Observation(name)
        return df.observe(self._held[name], F.coalesce(F.sum(F.lit(each).cast("long")), F.lit(0)).alias("rows"))

    @property
    def names(self) -> list[str]:
        """The stages in the order in which they were declared."""
        return list(self._held)

    def rows(self) -> dict[str, int]:
        """The rows of each stage, in order; waits for actions that have not run them yet."""
        return {name: held.get["rows"] for name, held in self._held.items()}


def excerpt(pcm: DataFrame, rate_hz: int, start: float = 0.0, end: float | None = None) -> DataFrame:
    """The samples (n, more columns) from a second up to another, numbered from 0; the filter reaches the scan of a table."""
    if start < 0 or (end is not None and end <= start):
        raise ValueError("an excerpt ends after it starts, and starts at 0 or later")
    first = int(start * rate_hz)
    held = pcm.where(F.col("n") >= first) if first else pcm
    held = held if end is None else held.where(F.col("n") < int(end * rate_hz))
    return held.withColumn("n", F.col("n") - first) if first else held


def checked(rate: int, sub: int) -> tuple[int, int]:
    """A rate within its range, and one part where the number of parts is none of the options."""
    return min(max(rate, TIME_RATES[0]), TIME_RATES[1]), sub if sub in SUBS else 1


def channel_spectra(pcm: DataFrame, win: int, hop: int | None = None) -> DataFrame:
    """(track, frame, m) of samples (track, ch, n, v), or of their blocks (track, ch, block, v).

    A track here is a struct of the track and one of mix, left and right.
    """
    held = pcm if "block" in pcm.columns else blocks.to_blocks(pcm, by=("track", "ch"))
    named = blocks.channels(held).select(F.struct("track", "channel").alias("track"), "block", "v")
    return transform.magnitudes(blocks.stft(named, win, hop))


def channel_columns(spectra: DataFrame, rate_hz: int, win: int, columns: int, sub: int = 1, range_db: float = 70.0) -> DataFrame:
    """(track, channel, col, q), q an array of the pooled ranges of spectral.kinds(), quantised against the joint peak of a track's three channels.

    The pooled columns, a small part of the spectra, are written once: the peak and the cells both need them.
    """
    ranges, _ = spectral.kinds(rate_hz, win, sub)
    power = spectral.band_power(spectral.placed(spectra, columns), rate_hz, win, sub, held=ranges)
    if sub > 1:
        power = power.withColumn("p", spectral.widen(F.col("p"), 88 * sub, sub))
    pooled = spectral.pooled(power, len(ranges))
    return spectral.quantised(cut(pooled.select("track.track", "track.channel", "col", "p")), range_db, digits=DIGITS)


def channel_cells(spectra: DataFrame, rate_hz: int, win: int, columns: int, sub: int = 1, range_db: float = 70.0) -> DataFrame:
    """(track, channel, row, col, q): the cells of channel_columns(), one for each pitch row."""
    held = channel_columns(spectra, rate_hz, win, columns, sub, range_db)
    places = F.array(*map(F.lit, spectral.kinds(rate_hz, win, sub)[1]))
    flat = held.select("track", "channel", "col", "q", F.posexplode(places).alias("row", "place"))
    return flat.select("track", "channel", "row", "col", F.get("q", F.col("place")).alias("q"))


def beat(spectra: DataFrame, seconds: float) -> DataFrame:
    """(track, bpm, offset) of the mix, from the rises of its spectrum; seconds: between frames."""
    mix = spectra.where(F.col("track.channel") == "mix").select("track.track", "frame", "m")
    rises = rhythm.flux(mix).select("track", (F.col("frame") - 1).alias("t"), F.col("flux").alias("x"))
    # one number a frame, read by each step of the estimate
    return rhythm.estimate(cut(rises), seconds)


def analyse(
    pcm: DataFrame,
    rate_hz: int,
    win: int,
    hop: int | None = None,
    rate: int = 15,
    sub: int = 1,
    columns: int = 60,
    range_db: float = 70.0,
    start: float = 0.0,
    end: float | None = None,
    stages: Stages | None = None,
) -> DataFrame:
    """(track, payload): for each track a JSON document of its spectra, envelopes, tempo and the settings they were made with.

    start and end, in seconds, choose an excerpt; lengths and beats are counted from its start, and a
    track that ends before it has no row.  stages counts the rows that each step hands on: decode, stft, aggregate, payload.
    """
    hop = transform.checked_hop(win, hop)
    rate, sub = checked(rate, sub)
    watch = stages.watch if stages else lambda _, df, each=1: df
    pcm = watch("decode", excerpt(pcm, rate_hz, start, end))
    spectra = watch("stft", channel_spectra(pcm, win, hop))
    # a stage's rows are its cells, of which a column has one for each pitch row
    cells = watch("aggregate", channel_columns(spectra, rate_hz, win, columns, sub, range_db), 88 * sub)
    named = cells.select(F.struct("track", "channel").alias("track"), "col", "q")
    each = spectral.packed_columns(named, spectral.kinds(rate_hz, win, sub)[1]).select("track.*", "n_cols", "spec", "envelope").groupBy("track").agg(
        F.max("n_cols").alias("nCols"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "spec")))).alias("specs"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "envelope")))).alias("envelopes"),
    )
    lengths = pcm.groupBy("track").agg((F.max("n") + 1).alias("samples"))
    held = each.join(lengths, "track").join(beat(spectra, hop / rate_hz), "track")
    seconds = F.col("samples") / float(rate_hz)
    pitches = range(spectral.LOW, spectral.HIGH + 1)
    fields = [
        F.col("track").cast("string").alias("file"),
        F.bround(seconds, 3).alias("durationSec"),
        F.lit(range_db).alias("dbRange"),
        F.lit(win).alias("window"),
        F.lit(float(start)).alias("offsetSec"),
        F.lit(end).cast("double").alias("endSec"),
        F.least(F.lit(FIRST_VIEW), F.bround(seconds, 3)).alias("initViewSec"),
        F.array(*(S.note_name(F.lit(p)) for p in pitches)).alias("noteLabels"),
        F.array(*(F.lit(i) for i, p in enumerate(pitches) if p % 12 == 0)).alias("cTickIdx"),
        F.array(*map(F.lit, TIME_RATES)).alias("timeRates"),
        F.array(*map(F.lit, SUBS)).alias("subOptions"),
        F.lit(rate).alias("defaultRate"),
        F.lit(sub).alias("defaultSub"),
        "bpm",
        F.col("offset").alias("beatOffsetSec"),
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("string").alias("stems"),
        "specs",
        "envelopes",
        "nCols",
        F.bround(F.lit(hop / rate_hz), 6).alias("hopSec"),
        F.lit(rate).alias("rate"),
        F.lit(sub).alias("sub"),
    ]
    return watch("payload", held).select("track", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def evaluate(pcm: DataFrame, reference: DataFrame, preset, rate_hz: int, win: int, hop: int | None = None, tolerance: float = 0.05) -> DataFrame:
    """(track, precision, recall, f1) of the notes found in samples (track, ch, n, v) against notes (id, track, pitch, start, end)."""
    from . import intervals, matching

    hop = transform.checked_hop(win, hop)
    spectra = channel_spectra(pcm, win, hop).where(F.col("track.channel") == "mix").select("track.track", "frame", "m")
    found = transcribed(spectra, preset, rate_hz, win, hop)
    estimate = found.withColumn("id", F.xxhash64("track", "pitch", "start"))
    return intervals.scores(reference, estimate, matching.match(reference, estimate, start=tolerance))


def transcribed(spectra: DataFrame, preset, rate_hz: int, win: int, hop: int) -> DataFrame:
    """(track, pitch, start, end, conf) of frames (track, frame, m)."""
    from . import intervals

    seconds = hop / rate_hz
    low, end = rhythm.band_bins(*preset.band, rate_hz, win)
    half = max(1, round(0.1 / seconds))
    onsets = rhythm.onsets(spectra, low, end, half, max(1, round(0.03 / seconds)), max(1, round(preset.least_gap / seconds)))
    return intervals.mono_notes(spectra, onsets, preset, rate_hz, win, seconds)
