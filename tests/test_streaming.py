"""Streaming twins give what the batch operators give."""

import datetime as dt
import time

import numpy as np

from resona.operators import rhythm
from resona.streaming import flows


def drain(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_flux_carries_the_last_frame(spark, tmp_path):
    m = np.random.default_rng(2).random((20, 4))
    rows = [("a", i, [float(x) for x in r]) for i, r in enumerate(m)]
    schema = "track string, frame long, m array<double>"
    for k in range(2):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = spark.createDataFrame(rows, schema)
    expected = {r.frame: r.flux for r in rhythm.flux(held, from_silence=True).collect()}
    drain(flows.flux(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))), "flux", "append")
    got = {r.frame: r.flux for r in spark.table("flux").collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_windows_and_sessions(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s), float(s)) for s in (0, 5, 12, 40, 44, 90)]
    schema = "track string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(flows.pooled(stream(), "10 seconds", "1 minute"), "pooled", "complete")
    assert sorted(r.value for r in spark.table("pooled").collect()) == [5.0, 12.0, 44.0, 90.0]
    drain(flows.sessions(stream(), "15 seconds", "1 minute"), "sessions", "complete")
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2, 3]


def test_hopping_windows_overlap_and_sessions_end_at_the_gap(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s), float(s)) for s in (0, 4, 9, 24, 34)]
    schema = "track string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(flows.hopping(stream(), "10 seconds", "5 seconds", "1 minute"), "hopping", "complete")
    got = {int((r.start - start).total_seconds()): (r.n, r.low, r.high) for r in spark.table("hopping").collect()}
    expected = {}
    for k in range(-5, 40, 5):
        held = [v for *_, v in rows if k <= v < k + 10]
        if held:
            expected[k] = (len(held), min(held), max(held))
    assert got == expected
    # a row exactly a gap after the last begins a new session
    drain(flows.sessions(stream(), "15 seconds", "1 minute"), "at_gap", "complete")
    assert sorted(r.n for r in spark.table("at_gap").collect()) == [2, 3]
    assert {(r.end - start).total_seconds() for r in spark.table("at_gap").collect()} == {24.0, 49.0}
    drain(flows.sessions(stream(), "10 seconds", "1 minute"), "over_gap", "complete")
    assert sorted(r.n for r in spark.table("over_gap").collect()) == [1, 1, 3]


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "track string, ts timestamp, value double"
    for k, seconds in enumerate(((0, 100), (101,), (5, 102), (300,))):
        held = spark.createDataFrame([("a", start + dt.timedelta(seconds=s), float(s)) for s in seconds], schema)
        held.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(flows.pooled(stream, "10 seconds", "10 seconds"), "late", "append")
    got = {int((r.start - start).total_seconds()): r.value for r in spark.table("late").collect()}
    assert got == {0: 0.0, 100: 102.0}
