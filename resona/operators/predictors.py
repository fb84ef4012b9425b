"""Models of notes as table functions, for SQL and for frames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .intervals import POLY_GAP, POLY_LEAST, merge_poly


def register(spark: SparkSession, name: str, predict: Callable[[np.ndarray], Iterable[tuple[int, float, float, float]]]) -> None:
    """Make a model a table function: name(samples) gives (pitch, start, end, conf) in samples since the chunk's start.

    ``select c.track, p.* from chunks c, lateral name(c.samples) p`` runs it once a chunk, in the tasks
    that hold the chunks; nothing is shuffled.  Null or empty samples give no rows.
    """

    class Predicted:
        def eval(self, samples):
            if samples is None or not len(samples):
                return
            for pitch, start, end, conf in predict(np.asarray(samples, float)):
                yield int(pitch), float(start), float(end), float(conf)

    spark.udtf.register(name, udtf(Predicted, returnType="pitch int, start double, end double, conf double"))


def predicted(chunks: DataFrame, name: str, gap: float = POLY_GAP, least: float = POLY_LEAST) -> DataFrame:
    """(track, pitch, start, end, conf): what a registered model finds in chunks (track, start, samples), merged over all chunks."""
    held = chunks.select("track", F.col("start").alias("_base"), "samples")
    found = held.sparkSession.sql(f"select c.track, c._base, p.* from {{held}} c, lateral {name}(c.samples) p", held=held)
    placed = found.select("track", "pitch", *((F.col(c) + F.col("_base")).alias(c) for c in ("start", "end")), "conf")
    return merge_poly(placed.withColumn("id", F.xxhash64("track", "pitch", "start", "end", "conf")), gap, least)
