"""Queries on series: autocorrelation, tempo, phase, beats, chunks and overlap-add."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import blocks, rhythm, separation, transform
from ..sources.tables import HOURLY, SIGNAL, hourly, read, signal
from .catalog import query
from .views import RAW_TAPS

LAGS, HOP = 48, 0.05

_AC = f"""mean as (select track, avg(x) as m from hourly group by track), dm as (select track, t, x - m as x from hourly join mean using (track)),
 raw as (select a.track, (b.t - a.t)::int as lag, sum(a.x * b.x) as ac from dm a join dm b on a.track = b.track and b.t >= a.t and b.t < a.t + {LAGS} group by all),
 ac as (select track, lag, ac / max(ac) over (partition by track) as ac from raw)"""


@query(f"with {HOURLY}, {_AC} select track, lag, round_even(ac, 6) as ac from ac")
def autocorr(spark, sf_dir):
    return rhythm.autocorrelation(hourly(spark, sf_dir), LAGS).withColumn("ac", F.bround("ac", 6))


_BPM = f"""cand as (select track, 50 + i.range * 0.5::double as bpm, least(greatest(60.0 / (50 + i.range * 0.5::double) / {HOP}, 0), {LAGS - 1})::double as lag from (select distinct track from ac), range(381) i),
 val as (select c.track, c.bpm, a.ac + (b.ac - a.ac) * (c.lag - floor(c.lag)) as v from cand c join ac a on a.track = c.track and a.lag = floor(c.lag) join ac b on b.track = c.track and b.lag = ceil(c.lag)),
 scored as (select track, bpm, round_even(v * case when bpm between 70 and 180 then 1.0 else 0.7 end, 9) as score from val),
 bpm as (select track, bpm, score from scored qualify row_number() over (partition by track order by score desc, bpm) = 1)"""


@query(f"with {HOURLY}, {_AC}, {_BPM} select track, bpm, score from bpm")
def bpm(spark, sf_dir):
    return rhythm.tempo(rhythm.autocorrelation(hourly(spark, sf_dir), LAGS), HOP)


_PHASE = f"""per as (select b.track, bpm, 60.0 / bpm / {HOP} as period, greatest(60.0 / bpm / {HOP} / 48, 0.5) as step, last, m from bpm b join (select track, max(t) as last from hourly group by track) using (track) join mean using (track)),
 ph as (select *, k * step as phase from (select *, unnest(range(ceil(period / step)::bigint)) as k from per) where k * step < period),
 pulse as (select track, bpm, k, phase, m, least(greatest(phase + j * period, 0), last)::double as spot from (select *, unnest(range(floor((last + 1 - phase) / period)::bigint)) as j from ph)),
 hit as (select p.track, bpm, k, phase, round_even(sum(a.x + (b.x - a.x) * (spot - floor(spot)) - m), 9) as score from pulse p join hourly a on a.track = p.track and a.t = floor(spot) join hourly b on b.track = p.track and b.t = ceil(spot) group by all),
 beat as (select track, round_even(bpm, 1) as bpm, round_even(phase * {HOP}, 3) as "offset" from hit qualify row_number() over (partition by track order by score desc, k) = 1)"""


def _phase(spark, sf_dir):
    series = hourly(spark, sf_dir)
    return rhythm.phase(series, rhythm.tempo(rhythm.autocorrelation(series, LAGS), HOP), HOP)


@query(f"with {HOURLY}, {_AC}, {_BPM}, {_PHASE} select * from beat")
def beat_phase(spark, sf_dir):
    return _phase(spark, sf_dir)


@query(f"""with {HOURLY}, {_AC}, {_BPM}, {_PHASE}, g as (select track, 240000.0 / bpm as bar, 60000.0 / bpm as beat, fmod(fmod("offset" * 1000, 240000.0 / bpm) + 240000.0 / bpm, 240000.0 / bpm) as first, (count * 50)::double as span
   from beat join (select track, count(*) as count from hourly group by track) using (track))
 select track, round_even(first + k * beat, 6) as ms, ((k % 4) + 4) % 4 = 0 as bar from (select *, unnest(range(-floor(first / beat)::bigint, floor((span - first) / beat)::bigint + 1)) as k from g)""")
def beat_grid(spark, sf_dir):
    spans = hourly(spark, sf_dir).groupBy("track").agg((F.count("*") * HOP * 1000).cast("double").alias("span"))
    return rhythm.beats(_phase(spark, sf_dir), spans)


CHUNK, OVERLAP = 16, 8
#: Samples of a block: the tracks of the tables are short.
SIZE = 256


def _held(spark, sf_dir):
    """The signal as blocks."""
    return blocks.to_blocks(signal(spark, sf_dir), SIZE)


def _around_zero(held, spans, name):
    """Least and greatest sample less 50 of each span, or 0 where that is beyond: from the levels of a pyramid."""
    found = blocks.extremes(held, blocks.pyramid(held, SIZE, cell=4, fan=4), spans, SIZE, cell=4, fan=4)
    return found.select("track", F.col(name).cast("int").alias(name), F.least(F.col("low") - 50, F.lit(0.0)).alias("low"), F.greatest(F.col("high") - 50, F.lit(0.0)).alias("high"))


_SIZES = "sizes as (select track, max(n) + 1 as total from signal group by track)"
_PLAN = f"""{_SIZES}, plan as (select track, i::int as chunk, case when total <= {CHUNK} then 0 else least(i * {CHUNK - OVERLAP}, total - {CHUNK}) end as start, case when total <= {CHUNK} then total else least(i * {CHUNK - OVERLAP}, total - {CHUNK}) + {CHUNK} end as "end"
  from (select *, unnest(range(case when total <= {CHUNK} then 1 else ceil((total - {CHUNK}) / {CHUNK - OVERLAP}.0)::bigint + 1 end)) as i from sizes))"""


def _plan(held):
    sizes = blocks.lengths(held, SIZE).withColumnRenamed("samples", "total")
    return separation.chunks(sizes, separation.pulled_back(F.col("total"), CHUNK, OVERLAP))


@query(f'with {SIGNAL}, {_PLAN} select track, chunk, start, "end" from plan')
def chunk_plan_dl(spark, sf_dir):
    return _plan(_held(spark, sf_dir))


@query(f"""with {SIGNAL}, {_SIZES}, p as (select track, i as chunk, i * 15 as start, least(i * 15 + 20, total) as "end" from (select *, unnest(range(ceil(greatest(total, 1) / 15.0)::bigint)) as i from sizes)),
 o as (select a.*, least(5, a."end" - a.start, b."end" - b.start, least(a.start + 15, total) - a.start) as fade from p a join p b on a.track = b.track and b.chunk = a.chunk - 1 join sizes z on z.track = a.track)
 select track, chunk::int as chunk, start + j.range as frame, round_even((j.range + 1) / (fade + 1.0), 9) as weight from o, range(5) j where j.range < fade""")
def rpca_crossfade_plan(spark, sf_dir):
    """Weights of the later of two chunks where they overlap."""
    sizes = signal(spark, sf_dir).groupBy("track").agg((F.max("n") + 1).alias("total"))
    plan = separation.chunks(sizes, separation.clipped(F.col("total"), 20, 5)).join(sizes, "track")
    held = plan.withColumn("fade", separation.faded(F.col("total"), 20, 5)).where("fade > 0")
    held = held.select("track", "chunk", "start", "fade", F.explode(F.sequence(F.lit(0), F.col("fade").cast("int") - 1)).alias("j"))
    return held.select("track", "chunk", (F.col("start") + F.col("j")).alias("frame"), F.bround((F.col("j") + 1) / (F.col("fade") + 1.0), 9).alias("weight"))


_BLEND = """part as (select s.track, s.n, v * (1 + 0.1 * chunk) as y, 0.5 - 0.5 * cos(2 * pi() * (n - start + 0.5) / ("end" - start)) as w from signal s join plan p on s.track = p.track and n >= start and n < "end")"""


@query(f"with {SIGNAL}, {_PLAN}, {_BLEND} select track, n, round_even(sum(w * y) / greatest(sum(w), 1e-30), 6) as v from part group by all")
def ola_blend(spark, sf_dir):
    held = _held(spark, sf_dir)
    parts = blocks.chunked(held, _plan(held), lambda x, row: {"y": transform.lists((x * (1 + 0.1 * row["chunk"]))[None, :])}, [T.StructField("y", transform.NUMBERS)], SIZE)
    return blocks.samples(blocks.blended(parts, SIZE), SIZE).withColumn("v", F.bround("v", 6))


@query(f"""with {SIGNAL}, {_PLAN}, part as (select s.track, p.chunk, s.n, 0.5 - 0.5 * cos(2 * pi() * (n - start + 0.5) / ("end" - start)) as w,
  sum(v) over c as whole, v - first_value(v) over c as rise from signal s join plan p on s.track = p.track and n >= start and n < "end" window c as (partition by s.track, p.chunk order by s.n)),
 stem as (select track, n, w, 'sum' as stem, whole as y from part union all select track, n, w, 'rise', rise from part)
 select track, stem, n, round_even(round_even(sum(w * y) / greatest(sum(w), 1e-30), 9), 4) as v from stem group by all""")
def infer_ola(spark, sf_dir):
    """An injected model run on each whole chunk, and the chunks blended; its stems, running sums and rises since the first sample, need the chunk in order."""
    held = _held(spark, sf_dir)

    def model(x):
        return [x.cumsum()[None, :], (x - x[0])[None, :]]

    parts = separation.infer_blocks(held, _plan(held), CHUNK, model, ("sum", "rise"), SIZE)
    by = ("track", "stem")
    return blocks.samples(blocks.blended(parts, SIZE, by), SIZE, by).withColumn("v", F.bround(F.bround("v", 9), 4))


_INNER = """unit as (select k, h / sum(h) over () as h from raw), z as (select track, max(n) + 1 as own from signal group by track),
 io as (select track, unnest(range(ceil(own * 3 / 2.0)::bigint)) as m from z), it as (select track, m, (m * 2 - k) // 3 as n, 3 * h as h from io, unit where (m * 2 - k) % 3 = 0),
 inside as (select t.track, t.m as n, sum(v * h) as v from it t join signal s on s.track = t.track and s.n = t.n group by t.track, t.m)"""
_OUTER = """bo as (select track, unnest(range(own)) as m from z), bt as (select track, m, (m * 3 - k) // 2 as n, 2 * h as h from bo, unit where (m * 3 - k) % 2 = 0)"""


@query(f"""with {SIGNAL}, {RAW_TAPS}, {_INNER}, {_PLAN.replace("from signal", "from inside")},
 rolled as (select i.track, pass.range as pass, (n + total * pass.range // 2) % total as n, v from inside i join sizes using (track), range(2) pass),
 part as (select r.track, pass, r.n, 0.5 - 0.5 * cos(2 * pi() * (n - start + 0.5) / ("end" - start)) as w, first_value(v) over c as base, v - first_value(v) over c as rise
   from rolled r join plan p on r.track = p.track and n >= start and n < "end" window c as (partition by r.track, pass, p.chunk order by r.n)),
 stem as (select track, pass, n, w, 'base' as stem, base as y from part union all select track, pass, n, w, 'rise', rise from part),
 blend as (select track, pass, stem, n, sum(w * y) / greatest(sum(w), 1e-30) as v from stem group by all),
 one as (select b.track, stem, (n - total * pass // 2 + total) % total as n, avg(v) as v from blend b join sizes using (track) group by all), {_OUTER}
 select t.track, stem, t.m as n, round_even(round_even(sum(v * h), 9), 4) + 0.0 as v from bt t join one o on o.track = t.track and o.n = t.n group by t.track, stem, t.m""")
def model_stems(spark, sf_dir):
    """All of a separation by a model of half the rate again: there, two passes of overlapping chunks, and back, for both of its stems.

    The model's stems are the first sample of a chunk, held, and what its samples rise above it.
    """

    def model(x):
        return [np.full((1, len(x)), x[0]), (x - x[0])[None, :]]

    found = separation.separate_by_model(_held(spark, sf_dir), 2, 3, CHUNK, OVERLAP, model, ("base", "rise"), 2, SIZE)
    return blocks.samples(found, SIZE, ("track", "stem")).withColumn("v", F.rint(F.bround("v", 9) * 1e4) / 1e4 + 0.0)


@query(f"""with {SIGNAL}, {_SIZES}, p as (select s.track, n, v, total, i.range as pass, total * i.range // 3 as roll from signal s join sizes using (track), range(3) i)
 select track, n, round_even(avg(v * (1 + 0.01 * (((n - roll) % total + total) % total))), 6) as v from p group by all""")
def shift_average(spark, sf_dir):
    samples = signal(spark, sf_dir)
    sizes = samples.groupBy("track").agg((F.max("n") + 1).alias("samples"))
    return separation.shifted_mean(samples, sizes, 3, lambda v, place: v * (1 + 0.01 * place)).withColumn("v", F.bround("v", 6))


@query(f"""with {SIGNAL}, {_SIZES}, px as (select track, i.range as px, (i.range * total) // 8 as a, greatest(((i.range + 1) * total) // 8, (i.range * total) // 8 + 1) as b from sizes, range(8) i)
 select p.track, px::int as px, least(min(v - 50), 0) as low, greatest(max(v - 50), 0) as high from px p join signal s on s.track = p.track and n >= a and n < b group by all""")
def lod_minmax(spark, sf_dir):
    """Least and greatest sample of each of 8 columns of a track, around zero."""
    held = _held(spark, sf_dir)
    a = F.floor(F.col("px") * F.col("total") / 8)
    b = F.greatest(F.floor((F.col("px") + 1) * F.col("total") / 8), a + 1)
    spans = blocks.lengths(held, SIZE).withColumnRenamed("samples", "total").withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return _around_zero(held, spans.select("track", "px", a.alias("a"), F.least(b, F.col("total")).alias("b")).where("a < b"), "px")


@query(f"with {SIGNAL}, {_SIZES} select track, (n // greatest(total // 10, 1))::int as bucket, least(min(v - 50), 0) as low, greatest(max(v - 50), 0) as high from signal join sizes using (track) where n // greatest(total // 10, 1) < 10 group by all")
def overview(spark, sf_dir):
    """Least and greatest sample of each of 10 equal buckets; the rest of a track is left out."""
    held = _held(spark, sf_dir)
    width = F.greatest(F.floor(F.col("samples") / 10), F.lit(1))
    spans = blocks.lengths(held, SIZE).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("a", F.col("bucket") * width)
    return _around_zero(held, spans.select("track", "bucket", "a", F.least(F.col("a") + width, F.col("samples")).alias("b")).where("a < b"), "bucket")


@query(f"""with {SIGNAL}, p as (select track, max(abs(v)) as peak from signal group by track), m as (select max(peak) as mix from p)
 select track, peak, round_even(least(greatest(20 * log10(greatest(mix, 1e-9) / greatest(peak, 1e-6)), 0.0), 12.0), 6) as db from p, m""")
def makeup_gain(spark, sf_dir):
    """Peak of each track, and the gain that lifts it to the greatest of all."""
    peaks = signal(spark, sf_dir).groupBy("track").agg(F.max(F.abs("v")).alias("peak"))
    mix = peaks.agg(F.max("peak").alias("mix"))  # one row
    return peaks.join(F.broadcast(mix), F.lit(True)).select("track", "peak", F.bround(S.makeup_db(F.col("mix"), F.col("peak")), 6).alias("db"))


@query("select event_type, count(*) as n, round_even(avg(value), 6) as mean, max(value) as top from events group by all")
def event_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.avg("value"), 6).alias("mean"), F.max("value").alias("top"))


@query("""with recursive o as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as k from events),
 r as (select event_type, k, value as speed from o where k = 1 union all select o.event_type, o.k, 0.7 * r.speed + 0.3 * o.value from r join o on o.event_type = r.event_type and o.k = r.k + 1)
 select event_type, k::int as k, round_even(speed, 6) as speed from r""")
def ewma_speed(spark, sf_dir):
    """All events, as ewma_speed_all has them."""
    return ewma_speed_all(spark, sf_dir)


@query()
def ewma_speed_all(spark, sf_dir):
    """The speed of a transfer, seven tenths the last and three tenths the new, at every event."""
    held = read(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "ts", "event_id", F.col("value").alias("x"))
    held = rhythm.numbered(held, "track", ("ts", "event_id")).select("track", F.col("k").cast("int").alias("k"), "x")
    return rhythm.smoothed(held, "k", "x", 0.7).select(F.col("track").alias("event_type"), "k", F.bround("smooth", 6).alias("speed"))


@query(f"""with {SIGNAL}, hourly as (select track, n as t, v as x from signal), long as (select track from signal group by track having count(*) >= 64 and max(v) > 0),
 {_AC}, {_BPM}, {_PHASE} select s.track, case when l.track is null then 120.0 else bpm end as bpm, case when l.track is null then 0.0 else "offset" end as "offset"
  from (select distinct track from signal) s left join long l using (track) left join beat b on b.track = s.track""")
def tempo_guarded(spark, sf_dir):
    """Tempo and phase of each user's values; a user of fewer than 64, or of none above 0, gets 120 and 0."""
    return rhythm.estimate(signal(spark, sf_dir).select("track", F.col("n").alias("t"), F.col("v").alias("x")), HOP)
