"""Streaming twins: pooled blocks, hopping windows, sessions, and flux that carries the frame before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .mixer import PROVIDER


def hopping(stream: DataFrame, size: str, hop: str, late: str, time: str = "ts", value: str = "value", by: str = "track") -> DataFrame:
    """Count, least and greatest value of each window of event time; rows later than the watermark are left out."""
    held = stream.withWatermark(time, late).groupBy(F.window(time, size, hop), by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return held.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "low", "high")


def pooled(stream: DataFrame, size: str, late: str, time: str = "ts", value: str = "value", by: str = "track") -> DataFrame:
    """The greatest value of each block of event time."""
    return hopping(stream, size, size, late, time, value, by).select(by, "start", F.col("high").alias("value"))


def sessions(stream: DataFrame, gap: str, late: str, time: str = "ts", by: str = "track") -> DataFrame:
    """Runs of rows that follow each other in less than the gap; a session ends a gap after its last row."""
    held = stream.withWatermark(time, late).groupBy(F.session_window(time, f"{gap} -1 microseconds"), by).agg(F.count("*").alias("n"))
    return held.select(by, F.col("session_window.start").alias("start"), (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("end"), "n")


class Rises(StatefulProcessor):
    """Keeps the last frame of a track as a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "m array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = np.array(self.last.get()[0]) if self.last.exists() else 0.0
        out = []
        for row in pd.concat(list(rows)).sort_values("frame").itertuples():
            m = np.asarray(row.m, float)
            out.append((key[0], row.frame, float(np.maximum(m - was, 0).sum())))
            was = m
        self.last.update((was.tolist(),))
        yield pd.DataFrame(out, columns=["track", "frame", "flux"])

    def close(self) -> None:
        pass


def flux(stream: DataFrame) -> DataFrame:
    """(track, frame, flux) of frames (track, frame, m) that arrive in order; the state of a track is its last frame."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = stream.select("track", "frame").schema.add("flux", "double")
    return stream.groupBy("track").transformWithStateInPandas(statefulProcessor=Rises(), outputStructType=schema, outputMode="Append", timeMode="None")
