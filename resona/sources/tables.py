"""The roles in which the engine reads tables: signals, frames, notes and series.

Each has its SQL twin, for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), ts)


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, n, v): a user's events in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.col("value").alias("v"))


SIGNAL = "signal as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as v from events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame, m): magnitudes by bin of each frame, an array."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("m"))


FRAMES = "frames as (select label as track, row_number() over (partition by label order by vec_id) - 1 as frame, list_transform(embedding, lambda x: abs(x::double)) as m from embeddings), bins as (select track, frame, unnest(m) as m, generate_subscripts(m, 1) - 1 as bin from frames)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track, pitch, start, end, conf): events as intervals in seconds."""
    start = micros(F.col("ts")) / 1e6
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("track"),
        (F.col("user_id") % 88 + 21).cast("int").alias("pitch"),
        start.alias("start"),
        (start + F.col("value") * 60).alias("end"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"),
    )


NOTES = "notes as (select event_id as id, event_type as track, (user_id % 88 + 21)::int as pitch, epoch_us(ts) / 1e6 as start, epoch_us(ts) / 1e6 + value * 60 as \"end\", least(value / 100, 1.0) as conf from events)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, t, x): events of a type in each hour from its first to its last, hours without any included."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("track"), F.floor(micros(F.col("ts")) / 3_600_000_000).alias("hour"))
    counts = events.groupBy("track", "hour").agg(F.count("*").cast("double").alias("x"))
    spans = events.groupBy("track").agg(F.min("hour").alias("low"), F.max("hour").alias("high"))
    hours = spans.select("track", "low", F.explode(F.sequence("low", "high")).alias("hour"))
    return hours.join(counts, ["track", "hour"], "left").select("track", (F.col("hour") - F.col("low")).alias("t"), F.coalesce("x", F.lit(0.0)).alias("x"))


HOURLY = """ev as (select event_type as track, epoch_us(ts) // 3600000000 as hour from events),
 cnt as (select track, hour, count(*)::double as x from ev group by all),
 span as (select track, min(hour) as low, max(hour) as high from ev group by track),
 hourly as (select h.track, h.hour - low as t, coalesce(x, 0.0) as x from (select track, low, unnest(range(low, high + 1)) as hour from span) h left join cnt using (track, hour))"""
