"""Queries on frames: bands, pooling, levels, transforms, peaks and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analysis, blocks, rhythm, separation, spectral, transform
from ..sources.tables import FRAMES, SIGNAL, frames, read, signal
from .catalog import query

WIN, RATE, BINS = 126, 8000, 64


def _bands_sql(sub: int, win: int = WIN, n_bins: int = BINS) -> str:
    return f"""axis as (select range as bin, range * {RATE} / {win}.0 as hz from range({n_bins})),
 tone as (select range as row, 440.0 * pow(2.0, (21 + range // {sub} - 0.5 - 69) / 12.0) as a, 440.0 * pow(2.0, (21 + range // {sub} + 0.5 - 69) / 12.0) as b from range({88 * sub}) r),
 edge as (select row, a * pow(b / a, (row % {sub}) / {sub}.0) as low, a * pow(b / a, (row % {sub} + 1) / {sub}.0) as high, {'440.0 * pow(2.0, (21 + row - 69) / 12.0)' if sub == 1 else '0.0'} as c0 from tone),
 band as (select row, low, high, {'c0' if sub == 1 else 'sqrt(low * high)'} as c from edge),
 inside as (select row, bin from band, axis where hz >= low and hz < high),
 member as (select * from inside union all
   select row, arg_min(bin, abs(hz - c)) from (select * from band where row not in (select row from inside)) b, axis group by row),
 power as (select track, frame, row, sum(m * m) as p from bins join member using (bin) group by all)"""


@query(f"with {FRAMES}, {_bands_sql(1)} select track, frame, row::int as row, round_even(p, 9) as p from power")
def band_energy(spark, sf_dir):
    held = spectral.band_power(frames(spark, sf_dir), RATE, WIN)
    return held.select("track", "frame", F.posexplode("p").alias("row", "p")).withColumn("p", F.bround("p", 9))


@query(f"with {FRAMES}, {_bands_sql(5)} select track, row::int as row, round_even(sum(p), 6) as p from power group by all")
def band_energy_sub5(spark, sf_dir):
    held = spectral.band_power(frames(spark, sf_dir), RATE, WIN, 5)
    return held.select("track", F.posexplode("p").alias("row", "p")).groupBy("track", "row").agg(F.bround(F.sum("p"), 6).alias("p"))


@query(f"""with {FRAMES}, {_bands_sql(5)}, k(d, w) as (values (-1, 1 / 6.0), (0, 2 / 6.0), (1, 2 / 6.0), (2, 1 / 6.0)),
 taps as (select range as row, greatest(0, least(439, range + d)) as source, w from range(440), k)
 select track, frame, t.row::int as row, round_even(sum(p * w), 9) as p from taps t join power s on s.row = t.source group by all""")
def widen_rows(spark, sf_dir):
    """All rows, as widen_rows_all has them."""
    return widen_rows_all(spark, sf_dir)


@query(f"""with {FRAMES}, {_bands_sql(5)}, k(d, w) as (values (-1, 1 / 6.0), (0, 2 / 6.0), (1, 2 / 6.0), (2, 1 / 6.0)),
 taps as (select range as row, greatest(0, least(439, range + d)) as source, w from range(440), k)
 select track, frame, t.row::int as row, round_even(sum(p * w), 9) as p from taps t join power s on s.row = t.source group by all""")
def widen_rows_all(spark, sf_dir):
    held = spectral.band_power(frames(spark, sf_dir), RATE, WIN, 5)
    return held.select("track", "frame", F.posexplode(spectral.widen(F.col("p"), 440, 5)).alias("row", "p")).withColumn("p", F.bround("p", 9))


_POOLED = """sizes as (select track, greatest(1, ceil((max(frame) + 1) / {n}.0))::bigint as block from frames group by track),
 pooled as (select track, row, frame // block as col, max(p) as p from power join sizes using (track) group by all)"""


@query(f"with {FRAMES}, power as (select track, frame, bin as row, m as p from bins), {_POOLED.format(n=10)} select track, row::int as row, col, p from pooled")
def downsample_max(spark, sf_dir):
    return spectral.pool(frames(spark, sf_dir), 10, "m").withColumn("p", F.col("p"))


_QUANTISED = "peaks as (select track, max(p) as peak from pooled group by track), quantised as (select track, row, col, round_even(least(greatest((greatest(10 * log10(greatest(p / peak, 1e-12)), -70.0) + 70.0) / 70.0, 0.0), 1.0) * 255, 0)::int as q from pooled join peaks using (track))"


def _quantised(spark, sf_dir):
    return spectral.quantised(spectral.pool(spectral.band_power(frames(spark, sf_dir), RATE, WIN), 20))


@query(f"with {FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}, {_QUANTISED} select track, row::int as row, col, q from quantised")
def spec_quantized(spark, sf_dir):
    return _quantised(spark, sf_dir)


@query(f"with {FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}, {_QUANTISED} select track, col, max(q) as top, round_even(max(q) / 255.0 * 70.0 - 70.0, 6) as db from quantised group by all")
def envelope(spark, sf_dir):
    return _quantised(spark, sf_dir).groupBy("track", "col").agg(F.max("q").alias("top")).withColumn("db", F.bround(S.dequantise(F.col("top"), 70.0), 6))


@query(f"with {FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}, {_QUANTISED} select track, row // 4 as row, col // 3 as col, max(round_even(q / 255.0 * 70.0 - 70.0, 6)) as db from quantised group by all")
def pool2d(spark, sf_dir):
    held = _quantised(spark, sf_dir).withColumn("db", F.bround(S.dequantise(F.col("q"), 70.0), 6))
    return held.groupBy("track", F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 3).alias("col")).agg(F.max("db").alias("db"))


@query(f"with {FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}, {_QUANTISED} select track, row::int as row, col, round_even(pow(least(greatest(q / 255.0 + 6.0 / 70.0, 0.0), 1.0), 1 / 0.8), 9) as level from quantised")
def intensity(spark, sf_dir):
    """All rows, as intensity_all has them."""
    return intensity_all(spark, sf_dir)


@query(f"with {FRAMES}, {_bands_sql(1)}, {_POOLED.format(n=20)}, {_QUANTISED} select track, row::int as row, col, round_even(pow(least(greatest(q / 255.0 + 6.0 / 70.0, 0.0), 1.0), 1 / 0.8), 9) as level from quantised")
def intensity_all(spark, sf_dir):
    return _quantised(spark, sf_dir).select("track", "row", "col", F.bround(S.intensity(F.col("q") / 255.0, 6.0, 70.0, 0.8), 9).alias("level"))


_FRAMED = """sizes as (select track, max(n) + 1 as samples from signal group by track),
 counted as (select track, samples, 1 + (samples + ((((-samples) % 4) + 4) % 4)) // 4 as frames from sizes),
 framed as (select s.track, s.n, s.v, f.frame, s.n - f.frame * 4 + 8 as i from signal s join counted c using (track),
   lateral (select unnest(range(greatest(0, floor((s.n - 8) / 4.0)::bigint + 1), least(c.frames - 1, floor((s.n + 8) / 4.0)::bigint) + 1)) as frame) f),
 windowed as (select *, v * (0.5 - 0.5 * cos(2 * pi() * i / 16)) as x from framed)"""


@query(f"with {SIGNAL}, {_FRAMED} select track, frame, b.range::int as bin, round_even(sum(x * cos(2 * pi() * b.range * i / 16)) / 8, 6) + 0.0 as re, round_even(sum(-x * sin(2 * pi() * b.range * i / 16)) / 8, 6) + 0.0 as im from windowed, range(9) b group by all")
def stft_dft16(spark, sf_dir):
    held = spectral.dft(signal(spark, sf_dir), 16)
    flat = held.select("track", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
    return flat.select("track", "frame", "bin", (F.bround("c.re", 6) + 0.0).alias("re"), (F.bround("c.im", 6) + 0.0).alias("im"))


_DFT = "dft as (select track, frame, b.range as bin, sum(x * cos(2 * pi() * b.range * i / 16)) / 8 as re, sum(-x * sin(2 * pi() * b.range * i / 16)) / 8 as im from windowed, range(9) b group by all)"


@query(f"with {SIGNAL}, {_FRAMED}, {_DFT} select track, frame, bin::int as bin, round_even(re, 6) + 0.0 as re, round_even(im, 6) + 0.0 as im from dft")
def stft_fft(spark, sf_dir):
    """The same as stft_dft16, by the transform of blocks that is there for windows of any size."""
    held = blocks.stft(blocks.to_blocks(signal(spark, sf_dir), 64), 16, size=64)
    flat = held.select("track", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
    return flat.select("track", "frame", "bin", (F.bround("c.re", 6) + 0.0).alias("re"), (F.bround("c.im", 6) + 0.0).alias("im"))


@query(f"with {SIGNAL} select track, n, round_even(v, 4) as v from signal")
def istft_fft(spark, sf_dir):
    """The signal itself, by way of a transform at a window of 2048."""
    held = blocks.to_blocks(signal(spark, sf_dir), 4096)
    back = blocks.istft(blocks.stft(held, 2048, 512, 4096), blocks.lengths(held, 4096), 2048, 512, 4096)
    return blocks.samples(back, 4096).withColumn("v", F.bround(F.bround("v", 9), 4))


@query(f"with {SIGNAL} select track, n, round_even(v, 4) as v, 2::bigint as stems from signal")
def stem_samples(spark, sf_dir):
    """The sum of the harmonic and percussive stems of each track, which is the track."""
    stems = separation.separate(signal(spark, sf_dir), "hpss", 64, 16, 256)
    return stems.groupBy("track", "n").agg(F.bround(F.bround(F.sum("v"), 7), 4).alias("v"), F.count("*").alias("stems"))


@query(f"""with {SIGNAL}, {_FRAMED}, {_DFT}, bins as (select track, frame, bin, sqrt(re * re + im * im) as m from dft), last as (select track, max(frame) as last from bins group by track),
 low as (select track, frame, bin, case when m > 1 then 1.0 else 0.25 end as k, re, im from bins join dft using (track, frame, bin))
 select track, frame, bin::int as bin, stem, round_even(re * case when stem = 'loud' then k else 1 - k end, 6) + 0.0 as re, round_even(im * case when stem = 'loud' then k else 1 - k end, 6) + 0.0 as im from low, (values ('loud'), ('soft')) t(stem)""")
def masked_spectra(spark, sf_dir):
    """A transform under the masks of two stems, each cell times its share."""
    spectra = transform.stft(signal(spark, sf_dir), 16, block=8)
    loud = F.transform("m", lambda m: F.when(m > 1, 1.0).otherwise(0.25))
    masks = transform.magnitudes(spectra).select("track", "frame", loud.alias("loud")).withColumn("soft", F.transform("loud", lambda k: 1 - k))
    held = transform.masked(spectra, masks, ("loud", "soft"))
    flat = held.select("track", "frame", "stem", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
    return flat.select("track", "frame", "bin", "stem", (F.bround("c.re", 6) + 0.0).alias("re"), (F.bround("c.im", 6) + 0.0).alias("im"))


_PCM = """pcm as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as n, value as l, json_extract_string(props, '$.k')::double as r from events),
 signal as (select track || '/mix' as track, n, (l + r) / 2 as v from pcm union all select track || '/left', n, l from pcm union all select track || '/right', n, r from pcm)"""


def _pcm(spark, sf_dir):
    """(track, ch, n, v): each user's events as samples of two channels."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    held = read(spark, sf_dir, "events").withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    both = F.posexplode(F.array("value", F.get_json_object("props", "$.k").cast("double"))).alias("ch", "v")
    return held.select(F.col("user_id").alias("track"), "n", both).select("track", "ch", "n", "v")


_CHANNELS = f"""{_PCM}, {_FRAMED}, {_DFT}, bins as (select track, frame, bin, sqrt(re * re + im * im) as m from dft), {_bands_sql(1, 16, 9)}, frames as (select distinct track, frame from bins),
 {_POOLED.format(n=10).replace("sizes", "blocks")}, named as (select split_part(track, '/', 1)::bigint as track, split_part(track, '/', 2) as channel, row, col, p from pooled), tops as (select track, max(p) as peak from named group by track),
 cells as (select track, channel, row::int as row, col, round_even(round(least(greatest((greatest(10 * log10(greatest(p / peak, 1e-12)), -70.0) + 70.0) / 70.0, 0.0), 1.0) * 255, 6), 0)::int as q from named join tops using (track))"""


@query(f"with {_CHANNELS} select * from cells")
def analysis_cells(spark, sf_dir):
    """Spectra of mix, left and right of each track, on the scale of their joint peak."""
    return analysis.channel_cells(analysis.channel_spectra(_pcm(spark, sf_dir), 16), RATE, 16, 10)


@query()
def analysis_payload(spark, sf_dir):
    """The document of each track; the cells in it are those of analysis_cells, and the tempo is tested on clicks."""
    return analysis.analyse(_pcm(spark, sf_dir), RATE, 16, columns=10)


@query(f"""with {_CHANNELS}, tall as (select track, channel, col, max(q) as top from cells group by all),
 e as (select track, channel, max(col) + 1 as n_cols, string_agg(top::varchar, ',' order by col) as envelope from tall group by all),
 spec as (select track, channel, base64(unhex(string_agg(printf('%02X', q), '' order by row, col))) as spec from cells group by all),
 long as (select track, round_even(count(*) / {RATE}.0, 3) as seconds from pcm group by track)
 select track, channel, seconds, least(15.0, seconds) as first_view, n_cols, spec, envelope, 'A0' as lowest, 'C8' as highest, 88 as labels, '3,15,27,39,51,63,75,87' as octaves, round_even(4 / {RATE}.0, 6) as step
  from spec join e using (track, channel) join long using (track)""")
def payload_fields(spark, sf_dir):
    """What the document of each track says, read back from its JSON, a row for each channel."""
    fields = "durationSec double, initViewSec double, nCols bigint, hopSec double, noteLabels array<string>, cTickIdx array<int>, specs map<string,string>, envelopes map<string,array<int>>"
    held = analysis.analyse(_pcm(spark, sf_dir), RATE, 16, columns=10).select("track", F.from_json("payload", fields).alias("p"))
    each = held.select("track", "p", F.explode("p.specs").alias("channel", "spec"))
    return each.select(
        "track", "channel", F.col("p.durationSec").alias("seconds"), F.col("p.initViewSec").alias("first_view"), F.col("p.nCols").alias("n_cols"), "spec",
        F.array_join(F.col("p.envelopes")[F.col("channel")].cast("array<string>"), ",").alias("envelope"),
        F.element_at("p.noteLabels", 1).alias("lowest"), F.element_at("p.noteLabels", -1).alias("highest"), F.size("p.noteLabels").alias("labels"),
        F.array_join(F.col("p.cTickIdx").cast("array<string>"), ",").alias("octaves"), F.col("p.hopSec").alias("step"),
    )


@query("select label as track, frame, frame // 3 as slice from (select label, row_number() over (partition by label order by vec_id) - 1 as frame from embeddings)")
def frame_slices(spark, sf_dir):
    """Frames by slices of a tenth of a second, 3 frames each."""
    return transform.slices(frames(spark, sf_dir).select("track", "frame"), 0.1, 480, 16)


@query(f"with {SIGNAL}, {_FRAMED} select track, frame, round_even(sum(x * x), 4) as energy from windowed group by all")
def parseval(spark, sf_dir):
    """The energy of each windowed frame, from its transform."""
    held = spectral.dft(signal(spark, sf_dir), 16)
    power = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    whole = F.aggregate(power, F.lit(0.0), lambda s, x: s + 2 * x) - F.element_at(power, 1) - F.element_at(power, 9)
    return held.select("track", "frame", F.bround(whole * 64 / 16, 4).alias("energy"))


@query(f"with {SIGNAL} select track, n, round_even(v, 4) as v from signal")
def istft_roundtrip(spark, sf_dir):
    """The signal itself, by way of its transform and overlap-add."""
    samples = signal(spark, sf_dir)
    sizes = samples.groupBy("track").agg((F.max("n") + 1).alias("samples"))
    return spectral.inverse(spectral.dft(samples, 16), sizes, 16).withColumn("v", F.bround(F.bround("v", 9), 4))


@query("""with e as (select event_id, value as a, json_extract_string(props, '$.k')::double as b from events)
 select event_id, 'mix' as channel, round_even((a + b) / 2, 6) as v from e union all select event_id, 'left', round_even(a, 6) from e union all select event_id, 'right', round_even(b, 6) from e""")
def channel_mix(spark, sf_dir):
    held = read(spark, sf_dir, "events").select("event_id", F.col("value").alias("left"), F.get_json_object("props", "$.k").cast("double").alias("right"))
    held = held.withColumn("right", F.coalesce("right", "left")).withColumn("mix", (F.col("left") + F.col("right")) / 2)
    return held.unpivot("event_id", ["mix", "left", "right"], "channel", "v").withColumn("v", F.bround("v", 6))


@query(f"""with {FRAMES}, n as (select *, lag(m) over w as a, lead(m) over w as c from bins window w as (partition by track, frame order by bin)),
 d as (select *, a - 2 * m + c as bend from n where a is not null and c is not null and m > a and m > c)
 select track, frame, bin::int as bin, round_even(case when bend <> 0 then 0.5 * (a - c) / bend else 0 end, 6) as pos, round_even(m - 0.25 * (a - c) * case when bend <> 0 then 0.5 * (a - c) / bend else 0 end, 6) as height from d""")
def parabolic_peaks(spark, sf_dir):
    at = F.posexplode(F.expr("transform(sequence(2, size(m) - 1), i -> struct(i - 1 as bin, m[i - 2] as a, m[i - 1] as b, m[i] as c))")).alias("_", "e")
    held = frames(spark, sf_dir).select("track", "frame", at).where("e.b > e.a and e.b > e.c")
    offset, height = spectral.parabolic(F.col("e.a"), F.col("e.b"), F.col("e.c"))
    return held.select("track", "frame", F.col("e.bin").alias("bin"), F.bround(offset, 6).alias("pos"), F.bround(height, 6).alias("height"))


_A = "pow((12194.0 * 12194.0 * f2 * f2 / ((f2 + 20.6 * 20.6) * sqrt((f2 + 107.7 * 107.7) * (f2 + 737.9 * 737.9)) * (f2 + 12194.0 * 12194.0))) / (12194.0 * 12194.0 * 1e12 / ((1e6 + 20.6 * 20.6) * sqrt((1e6 + 107.7 * 107.7) * (1e6 + 737.9 * 737.9)) * (1e6 + 12194.0 * 12194.0))), 0.25)"


@query(f"with {FRAMES}, h as (select *, pow(bin * {RATE} / {WIN}.0, 2) as f2 from bins) select track, frame, bin::int as bin, round_even(m * {_A}, 9) as m from h")
def a_weighting(spark, sf_dir):
    held = frames(spark, sf_dir).select("track", "frame", F.posexplode("m").alias("bin", "m"))
    return held.withColumn("m", F.bround(F.col("m") * S.a_weighting(F.col("bin") * RATE / float(WIN)), 9))


_MASKED = """last as (select track, max(frame) as last from frames group by track),
 cell as (select track, frame, bin, m from bins union all select track, unnest([-1, -2, last + 1, last + 2]) as frame, b.range, 0.0 from last, range(64) b),
 along as (select *, quantile_cont(m, 0.5) over (partition by track, bin order by frame rows between 2 preceding and 2 following) as h from cell),
 wide as (select track, frame, bin, m from bins union all select track, frame, unnest([-1, -2, 64, 65]), 0.0 from frames),
 across as (select track, frame, bin, quantile_cont(m, 0.5) over (partition by track, frame order by bin rows between 2 preceding and 2 following) as p from wide),
 medians as (select a.track, a.frame, a.bin, a.m, a.h, b.p from along a join across b using (track, frame, bin) join last using (track) where a.frame between 0 and last),
 masked as (select *, h * h / (h * h + p * p + 1e-10) as mh, p * p / (p * p + h * h + 1e-10) as mp from medians)"""


def _masked(spark, sf_dir):
    held = separation.medians(frames(spark, sf_dir), 5, 5).select("track", "frame", F.posexplode(F.arrays_zip("m", "h", "p")).alias("bin", "c"))
    held = held.select("track", "frame", "bin", "c.m", "c.h", "c.p")
    return held.withColumn("mh", S.wiener(F.col("h"), F.col("p"))).withColumn("mp", S.wiener(F.col("p"), F.col("h")))


@query(f"with {FRAMES}, {_MASKED} select track, frame, bin::int as bin, round_even(mh, 6) as mh, round_even(mp, 6) as mp from masked")
def hpss_masks(spark, sf_dir):
    return _masked(spark, sf_dir).select("track", "frame", "bin", F.bround("mh", 6).alias("mh"), F.bround("mp", 6).alias("mp"))


_DFT_MASKED = _MASKED.replace("range(64)", "range(9)").replace("[-1, -2, 64, 65]", "[-1, -2, 9, 10]")
_HANN = "(0.5 - 0.5 * cos(2 * pi() * i.range / 16))"


@query(f"""with {SIGNAL}, {_FRAMED}, {_DFT}, bins as (select track, frame, bin, sqrt(re * re + im * im) as m from dft), frames as (select distinct track, frame from bins), {_DFT_MASKED},
 shared as (select track, frame, bin, stem, re * case stem when 'harmonic' then mh else mp end as re, im * case stem when 'harmonic' then mh else mp end as im from masked join dft using (track, frame, bin), (values ('harmonic'), ('percussive')) s(stem)),
 back as (select track, stem, frame * 4 - 8 + i.range as n, {_HANN} * 8 / 16 * sum(case when bin in (0, 8) then 1 else 2 end * (re * cos(2 * pi() * bin * i.range / 16) - im * sin(2 * pi() * bin * i.range / 16))) as x, {_HANN} * {_HANN} as norm from shared, range(16) i group by track, stem, frame, i.range),
 added as (select track, stem, n, sum(x) / sum(norm) as v from back group by track, stem, n)
 select a.track, stem, a.n, round_even(round_even(a.v, 8), 4) + 0.0 as v from added a join signal s on s.track = a.track and s.n = a.n""")
def stem_parts(spark, sf_dir):
    """The harmonic and the percussive stem of each track, sample by sample: masks from medians, and the inverse of what they leave."""
    stems = separation.separate(signal(spark, sf_dir), "hpss", 16, 4, 64, time=5, freq=5)
    return stems.select("track", "stem", "n", (F.bround(F.bround("v", 8), 4) + 0.0).alias("v"))


@query(f"""with {FRAMES}, {_MASKED}, s as (select *, greatest(m - 0.05, 0.0) as sp, least(m, 0.05) as lo from masked),
 w as (select *, lo * lo / (lo * lo + sp * sp + 1e-10) as ml, sp * sp / (sp * sp + lo * lo + 1e-10) as ms from s)
 select track, frame, bin::int as bin, round_even(sqrt(mh * ml) / (sqrt(mh * ml) + sqrt(mp * ms) + 1e-10), 6) as share from w""")
def combined_masks(spark, sf_dir):
    """Median masks fused with those of the parts above and below a level."""
    held = _masked(spark, sf_dir)
    sparse = S.soft_threshold(F.col("m"), 0.05)
    low = F.col("m") - sparse
    return held.select("track", "frame", "bin", F.bround(S.fuse(F.col("mh"), S.wiener(low, sparse), F.col("mp"), S.wiener(sparse, low)), 6).alias("share"))


@query("""with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings)
 select vec_id, pos::int as pos, round_even(sign(x) * greatest(abs(x) - 0.05, 0.0), 9) as x from e""")
def soft_threshold(spark, sf_dir):
    held = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("pos", "x"))
    return held.withColumn("x", F.bround(S.soft_threshold(F.col("x"), 0.05), 9))


@query()
def rpca_masks(spark, sf_dir):
    """Masks of the low-rank and sparse parts; iterative, so without SQL."""
    held = separation.low_rank_masks(frames(spark, sf_dir), 40, 8)
    cells = held.select("track", "frame", F.posexplode(F.arrays_zip("lowrank", "sparse")).alias("bin", "c"))
    return cells.select("track", "frame", "bin", F.bround("c.lowrank", 6).alias("ml"), F.bround("c.sparse", 6).alias("ms"))


@query(f"with {FRAMES}, d as (select *, m - lag(m) over (partition by track, bin order by frame) as d from bins) select track, frame, round_even(sum(greatest(d, 0.0)), 6) as flux from d where d is not null group by all")
def flux_bpm(spark, sf_dir):
    return rhythm.flux(frames(spark, sf_dir)).withColumn("flux", F.bround("flux", 6))


_LOW, _END = rhythm.band_bins(200.0, 2000.0, RATE, WIN)


def flux_sql(low: int, end: int) -> str:
    return f"""d as (select *, m - lag(m, 1, 0.0) over (partition by track, bin order by frame) as d from bins where bin >= {low} and bin < {end}),
 flux as (select track, frame, sum(greatest(d, 0.0)) as flux from d group by all)"""


FLUX = flux_sql(_LOW, _END)


def onset_flux(spark, sf_dir):
    return rhythm.flux(frames(spark, sf_dir), _LOW, _END, from_silence=True)


@query(f"with {FRAMES}, {FLUX} select track, frame, round_even(flux, 6) as flux from flux")
def flux_onset(spark, sf_dir):
    return onset_flux(spark, sf_dir).withColumn("flux", F.bround("flux", 6))


_THRESHOLD = """ends as (select track, max(frame) as last, arg_min(flux, frame) as a, arg_max(flux, frame) as z from flux group by track),
 held as (select track, frame, flux, true as own from flux union all select track, -i.range - 1, a, false from ends, range(5) i union all select track, last + i.range + 1, z, false from ends, range(5) i),
 level as (select *, quantile_cont(flux, 0.5) over w + 0.15 * sqrt(greatest(avg(flux * flux) over w - avg(flux) over w * avg(flux) over w, 0.0)) as threshold from held window w as (partition by track order by frame rows between 5 preceding and 5 following))"""


@query(f"with {FRAMES}, {FLUX}, {_THRESHOLD} select track, frame, round_even(threshold, 6) as threshold from level where own")
def adaptive_threshold(spark, sf_dir):
    return rhythm.thresholds(onset_flux(spark, sf_dir), 5).select("track", "frame", F.bround("threshold", 6).alias("threshold"))


_PEAKS = """peaks as (select *, lag(frame) over w is not null and lead(frame) over w is not null
   and flux >= greatest(coalesce(max(flux) over (partition by track order by frame rows between 2 preceding and 1 preceding), 0), 0)
   and flux > greatest(coalesce(max(flux) over (partition by track order by frame rows between 1 following and 2 following), 0), 0) as peak
   from level where own window w as (partition by track order by frame))"""


@query(f"with {FRAMES}, {FLUX}, {_THRESHOLD}, {_PEAKS} select track, frame, peak from peaks")
def local_maxima(spark, sf_dir):
    return rhythm.peaks(onset_flux(spark, sf_dir), 2).select("track", "frame", "peak")


@query(f"""with recursive {FRAMES}, {FLUX}, {_THRESHOLD}, {_PEAKS}, c as (select track, frame from peaks where peak and flux > threshold),
 kept as (select track, min(frame) as frame from c group by track union all
   select track, frame from (select k.track, (select min(c.frame) from c where c.track = k.track and c.frame >= k.frame + 4) as frame from kept k) where frame is not null)
 select track, frame from kept""")
def onsets(spark, sf_dir):
    return rhythm.onsets(frames(spark, sf_dir), _LOW, _END, 5, 2, 4)
