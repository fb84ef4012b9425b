"""Queries that a view asks: payloads, overlays, ranges, resolutions, status and provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks, intervals, separation, spectral, views
from ..sources.tables import FRAMES, SIGNAL, frames, micros, read, signal
from .catalog import query
from .spectra import _POOLED, _QUANTISED, RATE, WIN, _bands_sql, _quantised

_CELLS = f"{FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}"


@query(f"""with {_CELLS}, {_QUANTISED}, w as (select track, max(col) + 1 as n_cols from quantised group by track)
 select track, n_cols, base64(unhex(string_agg(printf('%02X', q), '' order by row, col))) as spec from quantised join w using (track) group by track, n_cols""")
def payload_spec(spark, sf_dir):
    return spectral.packed(_quantised(spark, sf_dir), 88)


@query(f"with {_CELLS}, {_QUANTISED} select track, row::bigint as row, col, q from quantised")
def payload_decoded(spark, sf_dir):
    """The cells again, from the base64 of the payload."""
    return spectral.unpacked(spectral.packed(_quantised(spark, sf_dir), 88))


@query(f"""with {_CELLS}, {_QUANTISED}, s as (select track, max(col) + 1 as n_cols, count(*) as cells, max(q) as top from quantised group by track)
 select track, '{{"track":' || track || ',"rows":88,"nCols":' || n_cols || ',"dbRange":70,"rate":15,"sub":1,"cells":' || cells || ',"top":' || top || ',"notes":null,"stems":null}}' as payload from s""")
def payload_json(spark, sf_dir):
    """The document that describes a track's spectrogram."""
    held = _quantised(spark, sf_dir).groupBy("track").agg((F.max("col") + 1).alias("nCols"), F.count("*").alias("cells"), F.max("q").alias("top"))
    fields = ["track", F.lit(88).alias("rows"), "nCols", F.lit(70).alias("dbRange"), F.lit(15).alias("rate"), F.lit(1).alias("sub"), "cells", "top", F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("stems")]
    return held.select("track", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


@query(f"""with {_CELLS}, top as (select max(p) as peak from pooled) select track, row::int as row, col, round_even(least(greatest((greatest(10 * log10(greatest(p / peak, 1e-12)), -70.0) + 70.0) / 70.0, 0.0), 1.0) * 255, 0)::int as q from pooled, top""")
def stem_spec(spark, sf_dir):
    """Each track's cells against the peak of all tracks."""
    return spectral.quantised(spectral.pool(spectral.band_power(frames(spark, sf_dir), RATE, WIN), 20), joint=True)


@query(f"""with {_CELLS}, {_QUANTISED}, m as (select row, col, max(q) as master from quantised group by all) select track, row::int as row, col // 2 as bucket, max(q) as stem, max(master) as master from quantised join m using (row, col) group by all""")
def overlay(spark, sf_dir):
    """A track's cells beside those of all, in buckets of two columns."""
    cells = _quantised(spark, sf_dir)
    master = cells.groupBy("row", "col").agg(F.max("q").alias("master"))
    return cells.join(master, ["row", "col"]).groupBy("track", "row", F.floor(F.col("col") / 2).alias("bucket")).agg(F.max("q").alias("stem"), F.max("master").alias("master"))


@query(f"""with {_CELLS}, {_QUANTISED}, x as (select range as x from range(37)), s as (select x, floor((0.1 + (x + 0.5) * 0.9 / 37 - 0.03) / 0.05)::bigint as mine, floor((0.1 + (x + 0.5) * 0.9 / 37) / 0.07)::bigint as theirs from x),
 m as (select row, col, max(q) as master from quantised group by all),
 l as (select track, row, x, q from quantised join s on col = mine), u as (select row, x, master from m join s on col = theirs)
 select coalesce(l.x, u.x) as x, coalesce(l.row, u.row)::int as row, track, q as stem, master from l full join u on l.row = u.row and l.x = u.x where coalesce(l.row, u.row) between 12 and 60""")
def overlay_view(spark, sf_dir):
    """A track's cells, of 0.05 seconds from 0.03 on, over those of all, of 0.07 seconds, at the 37 columns and 49 rows of a view."""
    cells = _quantised(spark, sf_dir).where("row between 12 and 60")
    master = cells.groupBy("row", "col").agg(F.max("q").alias("master"))
    layer = views.aligned(cells, 0.05, 0.1, 1.0, 37, 0.03).select("row", "x", "track", F.col("q").alias("stem"))
    return layer.join(views.aligned(master, 0.07, 0.1, 1.0, 37).select("row", "x", "master"), ["row", "x"], "full")


_W = "sum(v * case when abs(d) < 1e-12 then 1.0 else sin(pi() * d) / (pi() * d) end * (0.5 + 0.5 * cos(pi() * d / 4)) / 1.5)"


@query(f"""with {SIGNAL}, z as (select track, ceil((max(n) + 1) * 2 / 3.0)::bigint as length from signal group by track),
 e as (select s.track, s.n, s.v, unnest(range(greatest(ceil((s.n - 6.0) * 2 / 3.0)::bigint, 0), least(floor((s.n + 6.0) * 2 / 3.0)::bigint, length - 1) + 1)) as m from signal s join z using (track)),
 k as (select track, m, v, (m * 3 / 2.0 - n) / 1.5 as d from e) select track, m as n, round_even({_W}, 6) as v from k group by track, m""")
def resample(spark, sf_dir):
    return spectral.resampled(signal(spark, sf_dir), 2, 3).withColumn("v", F.bround("v", 6))


#: Half the taps of the filter from 2 to 3 times the rate, and the modified Bessel function of its window.
_HALF = 30
_BESSEL = "list_sum(list_transform(range(0, 40), lambda j: pow(pow({x} / 2, j) / gamma(j + 1), 2)))"


RAW_TAPS = f"""raw as (select i.range - {_HALF} as k, case when i.range = {_HALF} then 1.0 else sin(pi() * (i.range - {_HALF}) / 3) / (pi() * (i.range - {_HALF}) / 3) end
   * {_BESSEL.format(x=f"(5.0 * sqrt(greatest(1 - pow((i.range - {_HALF}) / {_HALF}.0, 2), 0)))")} as h from range({2 * _HALF + 1}) i)"""


@query(f"""with {SIGNAL}, {RAW_TAPS},
 taps as (select k, 3 * h / sum(h) over () as h from raw), z as (select track, ceil((max(n) + 1) * 3 / 2.0)::bigint as length from signal group by track),
 o as (select track, unnest(range(length)) as m from z), t as (select track, m, (m * 2 - k) // 3 as n, h from o, taps where (m * 2 - k) % 3 = 0)
 select t.track, m as n, round_even(sum(v * h), 6) as v from t join signal s on s.track = t.track and s.n = t.n group by t.track, m""")
def resample_polyphase(spark, sf_dir):
    """Half as many samples again, through the branches of a Kaiser-windowed low-pass."""
    held = blocks.resampled(blocks.to_blocks(signal(spark, sf_dir), 256), 3, 2, 256)
    return blocks.samples(held, 256).withColumn("v", F.bround("v", 6))


@query("""with e as (select event_id, value - 10 as a, value * 0.5 + 5 as span from events),
 c as (select event_id, least(greatest(span, 1.0), 100.0) as span, a from e)
 select event_id, round_even(least(greatest(a, 0.0), 100.0 - span), 6) as start, round_even(least(greatest(a, 0.0), 100.0 - span) + span, 6) as stop from c""")
def clamped_range(spark, sf_dir):
    """A wanted range moved and cut so that it lies within bounds, its span kept where that can be."""
    span = S.clamp(F.col("value") * 0.5 + 5, 1.0, 100.0)
    start = F.least(F.greatest(F.col("value") - 10, F.lit(0.0)), 100.0 - span)
    return read(spark, sf_dir, "events").select("event_id", F.bround(start, 6).alias("start"), F.bround(start + span, 6).alias("stop"))


@query("""select event_id, least(greatest(value, 15.0), 60.0) as rate, case when user_id % 12 in (1, 5, 10) then user_id % 12 else 1 end as sub,
 list_min(list_filter([1, 2, 5, 10], lambda k: 10 % k = 0 and 440.0 / k <= greatest(value * 5, 44))) as factor from events""")
def resolution(spark, sf_dir):
    """The rate and parts that a request gets, and by how many rows the view pools to stay in its budget."""
    sub = F.col("user_id") % 12
    fits = F.filter(F.array(*map(F.lit, (1, 2, 5, 10))), lambda k: (10 % k == 0) & (440.0 / k <= F.greatest(F.col("value") * 5, F.lit(44.0))))
    return read(spark, sf_dir, "events").select("event_id", S.clamp(F.col("value"), 15.0, 60.0).alias("rate"), F.when(sub.isin(1, 5, 10), sub).otherwise(1).alias("sub"), F.array_min(fits).alias("factor"))


@query("""with e as (select event_id, value, user_id, make_timestamp(epoch_us(ts)) as moment, 1767225600000 + (value - 2.5) * 1000 as axis from events)
 select event_id, strftime(moment, '%Y-%m-%dT%H:%M:%S.%gZ') as stamp, epoch_us(moment) // 1000 as ms, round_even(axis, 3) as axis, round_even((axis - 1767225600000) / 1000.0 + 2.5, 3) as seconds,
 coalesce(list_min(list_filter([1000, 2000, 5000, 10000, 15000, 30000, 60000, 120000, 300000, 600000], lambda s: value * 100000 / s <= 16)), 600000) as tick,
 round_even(greatest(least(value + user_id % 41 - 20, 90.0), 2.5), 6) as sought from e""")
def axis_times(spark, sf_dir):
    """Times as text and read back, media time on a view's axis and back, steps between ticks, and jumps kept within a track."""
    offset, epoch_ms = 2.5, 1767225600000
    axis = S.axis_ms(F.col("value"), offset, epoch_ms)
    held = read(spark, sf_dir, "events").withColumn("stamp", S.iso_text(F.floor(micros(F.col("ts")) / 1000)))
    return held.select(
        "event_id", "stamp", S.stamp_ms(F.regexp_replace(F.col("stamp"), "T", " ")).alias("ms"), F.bround(axis, 3).alias("axis"),
        F.bround(S.media_seconds(axis, offset, epoch_ms), 3).alias("seconds"), S.tick_ms(F.col("value") * 100000).alias("tick"),
        F.bround(S.sought(F.col("value"), F.col("user_id") % 41 - 20, offset, 90.0), 6).alias("sought"),
    )


@query("""select user_id, arg_max(event_type, (ts, event_id)) as status, count(*) as steps, round_even(count(*) filter (event_type <> 'error') / count(*)::double, 4) as progress from events group by user_id""")
def task_status(spark, sf_dir):
    held = read(spark, sf_dir, "events").groupBy("user_id")
    return held.agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("steps"), F.bround(F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("progress"))


@query("""with o as (select user_id, event_type, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k, row_number() over (partition by user_id, event_type = 'view' order by ts desc, event_id desc) as j from events)
 select user_id, max(value) filter (k = 1) as value, max(event_type) filter (k = 1) as source, max(value) filter (j = 1 and event_type <> 'view') as origin from o group by user_id""")
def provenance(spark, sf_dir):
    """The last entry of each file; one from a cache keeps what the last one from elsewhere said of its origin."""
    order = [F.desc("ts"), F.desc("event_id")]
    held = read(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).withColumn("j", F.row_number().over(Window.partitionBy("user_id", F.col("event_type") == "view").orderBy(*order)))
    last = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    return held.groupBy("user_id").agg(last("value").alias("value"), last("event_type").alias("source"), F.max(F.when((F.col("j") == 1) & (F.col("event_type") != "view"), F.col("value"))).alias("origin"))


@query("""with r as (select event_id as id, user_id as track, (json_extract_string(props, '$.k')::int % 12 + 60) as pitch, epoch_us(ts) / 1e6 as start, epoch_us(ts) / 1e6 + value as "end", least(greatest(value / 50 - 0.5, 0.0), 1.0) as conf from events),
 near as (select *, max("end") over (partition by track, pitch order by start, id rows between unbounded preceding and 1 preceding) as reach from r),
 island as (select *, sum(case when reach is null or start - reach >= 40000 then 1 else 0 end) over (partition by track, pitch order by start, id) as island from near)
 select track, pitch, round_even(min(start), 3) as start, round_even(max("end"), 3) as "end", round_even(max(conf), 6) as conf from island group by track, pitch, island having max("end") - min(start) >= 0.03""")
def poly_notes(spark, sf_dir):
    """Events of a model, their fields from JSON, made into merged notes."""
    start = micros(F.col("ts")) / 1e6
    raw = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("track"), (F.from_json("props", "k int")["k"] % 12 + 60).alias("pitch"), start.alias("start"), (start + F.col("value")).alias("end"), S.clamp(F.col("value") / 50 - 0.5, 0.0, 1.0).alias("conf")
    )
    return intervals.merge_poly(raw, 40000.0).select("track", "pitch", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), F.bround("conf", 6).alias("conf"))


@query("""select event_id, round_even(pow(least(value / 100, 1.0), least(greatest(user_id % 9 * 0.75, 0.6), 5.0)), 9) as place from events""")
def gamma_scale(spark, sf_dir):
    """Anchors of a colour scale under gammas."""
    held = read(spark, sf_dir, "events")
    place = S.gamma_anchor(F.least(F.col("value") / 100, F.lit(1.0)), F.col("user_id") % 9 * 0.75)
    return held.select("event_id", F.bround(place, 9).alias("place"))


@query("""with p as (select event_id, user_id % 88 + 21 as pitch from events)
 select event_id, pitch * 5 + 2.0 as unit, round_even(((108 + 1) * 5 - 0.5 - (pitch * 5 + 2.0)) / ((108 + 1) * 5 - 0.5 - (21 * 5 - 0.5)), 9) as fraction from p""")
def row_geometry(spark, sf_dir):
    """Centre rows of pitches, and how far down the plot they are."""
    unit = S.row_centre(F.col("user_id") % 88 + 21, 5)
    return read(spark, sf_dir, "events").select("event_id", unit.alias("unit"), F.bround(S.plot_fraction(unit, 21, 108, 5), 9).alias("fraction"))


@query("""with e as (select event_id, value * 100 as a, value * 100 + 2000 as b, user_id % 5 * 0.5 + 0.25 as factor, case when user_id % 3 = 0 then null else value * 100 + 500 end as anchor from events),
 z as (select *, least(greatest(round_even((b - a) * factor, 0), 1000.0), 12000.0) as span, case when anchor is null then 0.5 else least(greatest((anchor - a) / (b - a), 0.0), 1.0) end as f from e),
 m as (select *, a + f * ((b - a) - span) as spot, a + value_by as pan from (select *, (factor - 1) * 3000 as value_by from z))
 select event_id, round_even(case when span >= 12000 then 0.0 else least(greatest(spot, 0.0), 12000.0 - span) end, 6) as zoom_start, round_even(case when span >= 12000 then 12000.0 else least(greatest(spot, 0.0), 12000.0 - span) + span end, 6) as zoom_end,
  round_even(least(greatest(pan, 0.0), 12000.0 - (b - a)), 6) as pan_start, round_even(least(greatest(pan, 0.0), 12000.0 - (b - a)) + (b - a), 6) as pan_end from m""")
def zoom_pan(spark, sf_dir):
    """Views zoomed around an anchor and moved, within 12 seconds."""
    user, a = F.col("user_id"), F.col("value") * 100
    b, factor = a + 2000, user % 5 * 0.5 + 0.25
    anchor = F.when(user % 3 != 0, a + 500)
    low, high = S.zoomed(a, b, factor, anchor, 0.0, 12000.0)
    left, right = S.panned(a, b, (factor - 1) * 3000, 0.0, 12000.0)
    named = zip(("zoom_start", "zoom_end", "pan_start", "pan_end"), (low, high, left, right), strict=True)
    return read(spark, sf_dir, "events").select("event_id", *(F.bround(c, 6).alias(n) for n, c in named))


@query("""select event_id, greatest(60, round_even(least(greatest(value, 15.0), 60.0) * value, 0)::int) as columns, least(greatest(60, round_even(least(greatest(value, 15.0), 60.0) * value * 20, 0)::int), 12000) as stem_columns from events""")
def column_counts(spark, sf_dir):
    """Columns of spectrograms of so many seconds; those of stems have a most."""
    rate, seconds = S.clamp(F.col("value"), 15.0, 60.0), F.col("value")
    return read(spark, sf_dir, "events").select("event_id", S.columns_of(seconds, rate).alias("columns"), S.columns_of(seconds * 20, rate, most=12000).alias("stem_columns"))


@query("""with u as (select user_id, list(event_type order by ts, event_id) as wanted from events group by user_id),
 k as (select user_id, list_filter(list_distinct(wanted), lambda x: x in ('click', 'purchase', 'view')) as kept, wanted from u),
 o as (select user_id, list_sort(list_transform(kept, lambda x: (list_position(wanted, x), x))) as placed from k),
 n as (select user_id, list_transform(placed, lambda x: x[2]) as names from o)
 select user_id, array_to_string(case when list_contains(names, 'view') then names else list_append(names, 'view') end, ',') as names from n""")
def preferred_names(spark, sf_dir):
    """What each user asks for among what is there, in order, with one name that is always last where it is not asked for."""
    wanted = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("wanted"))
    available = F.array(*map(F.lit, ("click", "purchase", "view")))
    return wanted.select("user_id", F.array_join(S.preferred(F.col("wanted"), available, "view"), ",").alias("names"))


@query("""with u as (select user_id, list(distinct event_type) as found from events group by user_id),
 m as (select user_id, list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: not list_contains(found, x)) as missing from u)
 select user_id, array_to_string(missing, ',') as missing, len(missing) = 0 as whole from m""")
def missing_names(spark, sf_dir):
    """Names of a registry that a user's output lacks, and whether it has all of them."""
    registry = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    held = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    gone = S.missing(registry, F.col("found"))
    return held.select("user_id", F.array_join(gone, ",").alias("missing"), (F.size(gone) == 0).alias("whole"))


@query("""select event_id, event_type as track from events where event_type in ('click', 'view')""")
def selected_tracks(spark, sf_dir):
    """The rows of both of two tracks."""
    preset = F.when(F.col("event_type") == "click", "bass").when(F.col("event_type") == "view", "lead")
    held = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("track"), preset.alias("preset"))
    return intervals.selected(held, "both").drop("preset")


@query("""select event_id, case when value > 1 and value < 90 then value else 120.0 end as bpm from events""")
def tempo_default(spark, sf_dir):
    """The tempo of each event, or the default where it is none."""
    stated = F.when(F.col("value") >= 90, float("inf")).when(F.col("value") > 1, F.col("value")).otherwise(-1.0)
    return read(spark, sf_dir, "events").select("event_id", S.tempo(stated).alias("bpm"))


@query("""with s(method, stem, place) as (values ('hpss', 'harmonic', 0), ('hpss', 'percussive', 1), ('combined', 'harmonic', 0), ('combined', 'percussive', 1), ('rpca', 'lowrank', 0), ('rpca', 'sparse', 1)),
 e as (select event_id, case user_id % 4 when 0 then 'hpss' when 1 then 'combined' when 2 then 'rpca' else 'other' end as method from events)
 select event_id, method, stem, place from e left join s using (method)""")
def method_stems(spark, sf_dir):
    """The stems of the method that each event asks for; none where there is no such method."""
    dimension = spark.createDataFrame([(m, s, i) for m in ("hpss", "combined", "rpca") for i, s in enumerate(separation.stems_of(m))], "method string, stem string, place int")
    method = F.element_at(F.array(*map(F.lit, ("hpss", "combined", "rpca", "other"))), (F.col("user_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", method.alias("method")).join(F.broadcast(dimension), "method", "left")
