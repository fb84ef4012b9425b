"""How well notes are found in a set of recordings, each beside a MIDI file of what is played in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import media, ranges
from . import analysis, blocks, intervals, matching, transform
from .lineage import cut

#: Endings of the files of notes, the first that is there being taken.
NOTES = (".mid", ".midi")


def _plain(path: Column) -> Column:
    """A path as the reader of blocks names it: without a scheme where it is a local file's."""
    return F.regexp_replace(path, "^file:/+", "/")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, piece, ending, content) of a folder's tree; the content is read only where it is asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = _plain(F.col("path"))
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return found.select(path.alias("path"), F.regexp_replace(path, r"\.[^./]*$", "").alias("piece"), ending.alias("ending"), "content")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(piece, audio, notes): the paths of a WAV file and a MIDI file whose names differ in the ending only.

    Recordings without notes and notes without a recording are left out; no content is read.
    """
    named = _listed(spark, folder).groupBy("piece")
    path = lambda ending: F.max(F.when(F.col("ending") == ending, F.col("path")))
    held = named.agg(path(".wav").alias("audio"), F.coalesce(*map(path, NOTES)).alias("notes"))
    return held.where("audio is not null and notes is not null")


def evaluate_folder(
    spark: SparkSession, folder: str, selection: str = "both", win: int = 8192, hop: int | None = None, tolerance: float = 0.05
) -> DataFrame:
    """(piece, preset, precision, recall, f1, n_ref, n_est): a row for each pair of files and preset of the selection.

    Recordings are read by ranges of bytes and mixed to one channel, block by block; a piece in which
    nothing is found, or nothing is to be found, has zeros.  One pass is made for each sample rate that the files
    have, since the bins of a band follow from it.
    """
    names, hop = intervals.names_of(selection), transform.checked_hop(win, hop)
    paired = cut(pairs(spark, folder))
    files = _listed(spark, folder).select("path", "content").join(paired.select(F.col("notes").alias("path"), "piece"), "path")
    reference = cut(media.notes_of(files.select(F.col("piece").alias("path"), "content")))
    sound = ranges.read_wav_blocks(spark, folder, ending=".wav").join(paired.select(F.col("audio").alias("track"), "piece"), "track")
    # the first block of each file tells its rate; there are as many rates as recorders have
    rates = sorted(r.rate for r in sound.where("block = 0").select("rate").distinct().collect())
    scored = []
    for rate in rates:
        mixed = cut(blocks.mono(sound.where(F.col("rate") == rate).select(F.col("piece").alias("track"), "block", "v")))
        spectra = transform.magnitudes(blocks.stft(mixed, win, hop))
        here = reference.join(mixed.select("track").distinct(), "track", "left_semi")
        for name in names:
            found = analysis.transcribed(spectra, intervals.preset_of(name), rate, win, hop)
            # few rows, each counted and matched
            estimate = cut(found.withColumn("id", F.xxhash64("pitch", "start")))
            scored.append(_scored(here, estimate, name, tolerance))
    presets = F.explode(F.array(*map(F.lit, names))).alias("preset")
    wanted = paired.select("piece", presets)
    none = spark.createDataFrame([], "piece string, preset string, precision double, recall double, f1 double, n_ref long, n_est long")
    for each in scored:
        none = none.unionByName(each)
    counted = reference.groupBy(F.col("track").alias("piece")).agg(F.count("*").alias("notes"))
    held = wanted.join(none, ["piece", "preset"], "left").join(counted, "piece", "left")
    # a piece that gave no row in a pass still has the notes that it should have
    filled = held.withColumn("n_ref", F.coalesce("n_ref", "notes")).drop("notes")
    return filled.na.fill(0, ["precision", "recall", "f1", "n_ref", "n_est"])


def _scored(reference: DataFrame, estimate: DataFrame, preset: str, tolerance: float) -> DataFrame:
    scores = intervals.scores(reference, estimate, matching.match(reference, estimate, start=tolerance))
    count = lambda df, name: df.groupBy("track").agg(F.count("*").alias(name))
    held = scores.join(count(reference, "n_ref"), "track", "left").join(count(estimate, "n_est"), "track", "left")
    return held.select(F.col("track").alias("piece"), F.lit(preset).alias("preset"), "precision", "recall", "f1", "n_ref", "n_est")


def summary(scored: DataFrame) -> DataFrame:
    """(preset, files, precision, recall, f1): plain means over the pieces of evaluate_folder()."""
    means = (F.bround(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1"))
    return scored.groupBy("preset").agg(F.count("*").alias("files"), *means)
