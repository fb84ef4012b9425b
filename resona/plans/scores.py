"""Queries on notes: salience, decoding, segments, merging, views, events of MIDI files, names and keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks, decoding, intervals, lineage, matching, rhythm, store, views
from ..sources import media
from ..sources.tables import FRAMES, NOTES, SIGNAL, frames, notes, read, signal
from .catalog import query
from .spectra import _PEAKS, _THRESHOLD, RATE, WIN, flux_sql

LEAD = intervals.PRESETS["lead"]
TEMPO, OFFSET, START = 96.0, 0.25, 1704067200.0

_SALIENCE = f"""grid as (select range as pitch from range({LEAD.low - 12}, {LEAD.high + 1})),
 harm as (select pitch, k.range + 1 as k, least(greatest(round_even((k.range + 1) * 440 * pow(2.0, (pitch - 69) / 12.0) * {WIN} / {RATE}.0, 0)::bigint, 1), {WIN // 2 - 1}) as bin from grid, range({LEAD.harmonics}) k where (k.range + 1) * 440 * pow(2.0, (pitch - 69) / 12.0) < {RATE / 2}),
 near as (select *, (lag(m) over w + m + lead(m) over w) / 3 as m3 from bins window w as (partition by track, frame order by bin)),
 ext as (select track, frame, pitch, sum(m3 / k) as e from near join harm using (bin) group by all),
 sal as (select f.track, f.frame, g.pitch, greatest(coalesce(a.e, 0) - {LEAD.suppression} * coalesce(b.e, 0), 0.0) as s from frames f join grid g on g.pitch >= {LEAD.low}
   left join ext a on a.track = f.track and a.frame = f.frame and a.pitch = g.pitch left join ext b on b.track = f.track and b.frame = f.frame and b.pitch = g.pitch - 12),
 norm as (select track, frame, pitch, coalesce((s - min(s) over w) / nullif(max(s) over w - min(s) over w, 0), 0.0) as s from sal window w as (partition by track))"""


def _flat(df):
    return df.select("track", "frame", F.posexplode("s").alias("pitch", "s")).select("track", "frame", (F.col("pitch") + LEAD.low).alias("pitch"), F.bround("s", 6).alias("s"))


@query(f"with {FRAMES}, {_SALIENCE} select track, frame, pitch::int as pitch, round_even(s, 6) as s from sal")
def salience(spark, sf_dir):
    return _flat(intervals.salience(frames(spark, sf_dir), LEAD, RATE, WIN))


@query(f"with {FRAMES}, {_SALIENCE} select track, frame, pitch::int as pitch, round_even(s, 6) as s from norm")
def salience_norm(spark, sf_dir):
    return _flat(intervals.normalised(intervals.salience(frames(spark, sf_dir), LEAD, RATE, WIN)))


N, HOP = LEAD.high - LEAD.low + 1, 0.01
def _viterbi(hop: float) -> str:
    return f"""step as (select a.range as p, b.range as q, {hop} * case when a.range = {N} and b.range = {N} then {LEAD.rest_stay} when a.range = {N} then {LEAD.rest_in} when b.range = {N} then {LEAD.rest_out} when a.range = b.range then 0.0
   when abs(a.range - b.range) >= 12 and abs(a.range - b.range) % 12 = 0 then {LEAD.octave_cost} * (abs(a.range - b.range) // 12) else {LEAD.pitch_cost} * abs(a.range - b.range) end as c from range({N + 1}) a, range({N + 1}) b),
 emit as (select track, frame, (pitch - {LEAD.low})::bigint as q, 1 - s as e from norm union all select track, frame, {N}, {LEAD.rest_emission} from frames),
 ahead as (select track, frame, q, e as v from emit where frame = 0 union all
   select h.track, h.frame + 1, t.q, min(h.v + t.c) + any_value(m.e) from ahead h join step t on t.p = h.q join emit m on m.track = h.track and m.frame = h.frame + 1 and m.q = t.q group by h.track, h.frame + 1, t.q),
 last as (select track, max(frame) as last from frames group by track),
 back as (select track, last as frame, range as q, 0.0::double as v from last, range({N + 1}) union all
   select h.track, h.frame - 1, t.p, min(h.v + t.c + m.e) from back h join step t on t.q = h.q join emit m on m.track = h.track and m.frame = h.frame and m.q = h.q where h.frame > 0 group by h.track, h.frame - 1, t.p),
 states as (select a.track, a.frame, arg_min(a.q, a.v + b.v)::int as state from ahead a join back b using (track, frame, q) group by all)"""


def _scaled(spark, sf_dir):
    return intervals.normalised(intervals.salience(frames(spark, sf_dir), LEAD, RATE, WIN))


@query(f"with recursive {FRAMES}, {_SALIENCE}, {_viterbi(HOP)} select * from states")
def viterbi_states(spark, sf_dir):
    """The cheapest path; SQL has it as the least sum of costs so far and costs to come."""
    return intervals.decode(_scaled(spark, sf_dir), HOP, LEAD)


@query(f"with recursive {FRAMES}, {_SALIENCE}, {_viterbi(HOP)} select * from states")
def viterbi_chunks(spark, sf_dir):
    """The cheapest path, with the frames of a track in chunks that are decoded side by side."""
    return decoding.decode_chunks(_scaled(spark, sf_dir), HOP, LEAD, 32)


_RUNS = """typed as (select user_id as track, event_type as state, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events),
 marked as (select *, case when state = lag(state) over w then 0 else 1 end as new from typed window w as (partition by track order by frame)),
 numbered as (select *, sum(new) over (partition by track order by frame) as run from marked),
 runs as (select track, any_value(state) as state, min(frame) as f0, max(frame) + 1 as f1 from numbered group by track, run),
 sung as (select * from runs where state <> 'view')"""


def _runs(spark, sf_dir):
    typed = read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("event_type").alias("state"), "ts", "event_id")
    held = typed.withColumn("frame", (F.row_number().over(Window.partitionBy("track").orderBy("ts", "event_id")) - 1).cast("long"))
    return intervals.runs(held.select("track", "state", "frame"), rest="view")


@query(f"with {_RUNS} select * from sung")
def segments(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"""with {_RUNS}, near as (select *, case when state = lag(state) over w and (f0 - lag(f1) over w) * 0.03 <= 0.06 + 1e-9 then 0 else 1 end as new from sung window w as (partition by track order by f0)),
 island as (select *, sum(new) over (partition by track order by f0) as island from near)
 select track, any_value(state) as state, min(f0) as f0, max(f1) as f1 from island group by track, island""")
def merge_mono(spark, sf_dir):
    return intervals.merge_mono(_runs(spark, sf_dir), 0.03)


@query(f"""with {NOTES}, near as (select *, max("end") over (partition by track, pitch order by start, id rows between unbounded preceding and 1 preceding) as reach from notes),
 island as (select *, sum(case when reach is null or start - reach >= 600 then 1 else 0 end) over (partition by track, pitch order by start, id) as island from near)
 select track, pitch, round_even(min(start), 3) as start, round_even(max("end"), 3) as "end", max(conf) as conf from island group by track, pitch, island having max("end") - min(start) >= 0.03""")
def merge_poly(spark, sf_dir):
    held = intervals.merge_poly(notes(spark, sf_dir), 600.0)
    return held.select("track", "pitch", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "conf")


@query(f"""with {_RUNS}, o as (select track, frame from typed where state = 'click'), p as (select distinct track, f0 as frame from sung)
 select p.track, p.frame, coalesce(min(o.frame), p.frame) as snapped from p left join o on o.track = p.track and o.frame between p.frame - 1 and p.frame + 1 group by p.track, p.frame""")
def snap(spark, sf_dir):
    typed = read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), "event_type", "ts", "event_id")
    held = typed.withColumn("frame", (F.row_number().over(Window.partitionBy("track").orderBy("ts", "event_id")) - 1).cast("long"))
    points = _runs(spark, sf_dir).select("track", F.col("f0").alias("frame")).distinct()
    return intervals.snapped(points, held.where("event_type = 'click'"))


def _segments(hop: float) -> str:
    return f"""marked0 as (select *, case when state = lag(state) over w then 0 else 1 end as new from states window w as (partition by track order by frame)),
 numbered0 as (select *, sum(new) over (partition by track order by frame) as run from marked0),
 sung0 as (select * from (select track, any_value(state) as state, min(frame) as f0, max(frame) + 1 as f1 from numbered0 group by track, run) where state <> {N}),
 near0 as (select *, case when state = lag(state) over w and (f0 - lag(f1) over w) * {hop} <= 0.06 + 1e-9 then 0 else 1 end as new from sung0 window w as (partition by track order by f0)),
 island0 as (select *, sum(new) over (partition by track order by f0) as island from near0),
 seg as (select track, any_value(state) as state, min(f0) as f0, max(f1) as f1 from island0 group by track, island)"""


@query(f"""with recursive {FRAMES}, {_SALIENCE}, {_viterbi(HOP)}, {_segments(HOP)}
 select p.track, state, f0, f1, round_even(least(greatest(avg(round_even(s, 12)), 0), 1), 4) as conf from seg p join norm n on n.track = p.track and n.frame >= f0 and n.frame < f1 and n.pitch = {LEAD.low} + state group by all""")
def note_conf(spark, sf_dir):
    """The confidence of each segment that decoding finds over all frames of a track."""
    return note_conf_segments(spark, sf_dir)


@query()
def note_conf_segments(spark, sf_dir):
    """The same rows as note_conf, which has the SQL."""
    scaled = _scaled(spark, sf_dir)
    return intervals.confidences(intervals.merge_mono(intervals.runs(intervals.decode(scaled, HOP, LEAD), rest=N), HOP), scaled)


_BAND = rhythm.band_bins(*LEAD.band, RATE, WIN)


@query(f"""with recursive {FRAMES}, {_SALIENCE}, {_viterbi(0.05)}, {_segments(0.05)}, {flux_sql(*_BAND)}, {_THRESHOLD}, {_PEAKS}, c as (select track, frame from peaks where peak and flux > threshold),
 kept as (select track, min(frame) as frame from c group by track union all
   select track, frame from (select k.track, (select min(c.frame) from c where c.track = k.track and c.frame >= k.frame + 4) as frame from kept k) where frame is not null),
 moved as (select s.track, s.state, s.f0 as a, s.f1 as b, coalesce(min(o.frame) filter (abs(o.frame - s.f0) <= 1), s.f0) as f0, coalesce(min(o.frame) filter (abs(o.frame - s.f1) <= 1), s.f1) as f1
   from seg s left join kept o on o.track = s.track and (abs(o.frame - s.f0) <= 1 or abs(o.frame - s.f1) <= 1) group by s.track, s.state, s.f0, s.f1),
 long as (select * from moved where (f1 - f0) * 0.05 >= {LEAD.least_note})
 select l.track, (state + {LEAD.low})::int as pitch, round_even(f0 * 0.05, 4) as start, round_even(f1 * 0.05, 4) as "end", round_even(least(greatest(avg(s), 0), 1), 4) as conf
 from long l join norm n on n.track = l.track and n.frame >= f0 and n.frame < greatest(f1, f0 + 1) and n.pitch = {LEAD.low} + state group by l.track, state, a, b, f0, f1""")
def mono_notes(spark, sf_dir):
    """All of the way from frames to notes."""
    held = frames(spark, sf_dir)
    low, end = rhythm.band_bins(*LEAD.band, RATE, WIN)
    return intervals.mono_notes(held, rhythm.onsets(held, low, end, 5, 2, 4), LEAD, RATE, WIN, 0.05)


_TICKS = f"""ev as (select id, track, pitch, start - {START} as s, "end" - {START} as e, conf from notes),
 tick as (select *, greatest(0, round_even((s - {OFFSET}) * 480 * {TEMPO} / 60, 0)::bigint) as on_tick from ev),
 pair as (select *, greatest(0, round_even((e - {OFFSET}) * 480 * {TEMPO} / 60, 0)::bigint, on_tick + 1) as off_tick from tick),
 midi as (select track, on_tick as tick, 1 as kind, pitch, least(greatest(64 + round_even(63 * conf, 0), 1), 127)::int as velocity, id from pair union all select track, off_tick, 0, pitch, 0, id from pair)"""


def _midi(spark, sf_dir, times: int = 1):
    """Events of the notes, so many times as fast as they are."""
    held = notes(spark, sf_dir).withColumns({c: (F.col(c) - START) / float(times) for c in ("start", "end")})
    return intervals.midi_events(held, TEMPO, OFFSET)


@query(f"with {NOTES}, {_TICKS} select track, tick, kind, pitch, velocity, id from midi")
def midi_ticks(spark, sf_dir):
    return _midi(spark, sf_dir)


@query(f"with {NOTES}, {_TICKS} select track, id, kind, tick - coalesce(lag(tick) over (partition by track order by tick, kind, id), 0) as delta from midi")
def midi_deltas(spark, sf_dir):
    return intervals.deltas(_midi(spark, sf_dir)).select("track", "id", "kind", "delta")


def _little(x: str, size: int) -> str:
    """SQL of a number's little-endian bytes as hex digits."""
    return " || ".join(f"substr(printf('%0{2 * size}x', ({x})::bigint), {i}, 2)" for i in range(2 * size - 1, 0, -2))


def _hex(x: str, digits: int) -> str:
    return f"printf('%0{digits}x', ({x})::bigint)"


def _numbered(x: str) -> str:
    """SQL of a MIDI variable-length number's hex digits, below 2 to the 28th."""
    low = _hex(f"{x} % 128", 2)
    more = [f"case when {x} >= {1 << 7 * k} then {_hex(f'128 + ({x} >> {7 * k}) % 128', 2)} else '' end" for k in (3, 2, 1)]
    return " || ".join([*more, low])


_TEMPO_HEX = f"00ff5103{round(60_000_000 / TEMPO):06x}"
# a delta has 28 bits at most, some four days at this tempo, so the months of the events pass a thousand times as fast
_FAST = 1000
_FAST_TICKS = _TICKS.replace(f"start - {START} as s", f"(start - {START}) / {_FAST}.0 as s").replace(f'"end" - {START} as e', f'("end" - {START}) / {_FAST}.0 as e')
# a user's notes: a track of each type of event, the tempo in one of its own where there are several
_MIDI_FILE = f"""mine as (select user_id as file, m.* from midi m join events on event_id = m.id),
 gap as (select file, track, tick, kind, pitch, velocity, id, tick - coalesce(lag(tick) over (partition by file, track order by tick, kind, id), 0) as delta from mine),
 line as (select file, track, string_agg({_numbered("delta")} || case kind when 1 then '90' else '80' end || {_hex("pitch", 2)} || {_hex("velocity", 2)}, '' order by tick, kind, id) as events from gap group by file, track),
 counted as (select *, count(*) over (partition by file) as tracks from line),
 named as (select file, track, tracks, case when tracks = 1 then '{_TEMPO_HEX}' else '' end || '00ff03' || {_hex("length(track)", 2)} || lower(hex(encode(track))) || events || '00ff2f00' as body from counted),
 chunk as (select file, track, tracks, '4d54726b' || {_hex("length(body) // 2", 8)} || body as chunk from named),
 whole as (select file, '4d54686400000006' || case when max(tracks) = 1 then '0000' else '0001' end || {_hex("case when max(tracks) = 1 then 1 else max(tracks) + 1 end", 4)} || '01e0'
   || case when max(tracks) = 1 then '' else '4d54726b' || {_hex(str(len(_TEMPO_HEX) // 2 + 4), 8)} || '{_TEMPO_HEX}00ff2f00' end || string_agg(chunk, '' order by track) as content from chunk group by file)"""


@query(f"with {NOTES}, {_FAST_TICKS}, {_MIDI_FILE} select file, length(content) // 2 as bytes, sha256(unhex(content)) as sha256 from whole")
def midi_bytes(spark, sf_dir):
    """A MIDI file of each user's notes, by its digest: a track of each type of event."""
    users = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file"))
    mine = _midi(spark, sf_dir, _FAST).join(users, "id")
    held = intervals.deltas(mine, ("file", "track"))
    return media.one_midi(held, "file", TEMPO).select("file", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


# samples of 16 bits, cut towards zero
_PCM16 = f"""pcm as (select track, n, trunc(least(greatest(v / 100 - 0.5, -1.0), 1.0) * 32767)::bigint as x from signal),
 body as (select track, count(*) as n, string_agg({_little("(x + 65536) % 65536", 2)}, '' order by n) as hex from pcm group by track)"""
_WAV_HEADER = " || ".join(["'52494646'", _little("36 + 2 * n", 4), "'57415645666d7420' || '10000000' || '01000100'", _little("8000", 4), _little("16000", 4), "'02001000' || '64617461'", _little("2 * n", 4)])


def _small(spark, sf_dir):
    return signal(spark, sf_dir).withColumn("v", F.col("v") / 100 - 0.5)


@query(f"with {SIGNAL}, {_PCM16} select track, n, n * 2 + 44 as bytes, sha256(unhex({_WAV_HEADER} || hex)) as sha256 from body")
def wav_bytes(spark, sf_dir):
    """The size and digest of a WAV file of each track."""
    held = blocks.to_blocks(_small(spark, sf_dir), 4096)
    size = blocks.lengths(held, 4096).withColumnRenamed("samples", "n")
    files = blocks.wav_files(held, 8000, 4096)
    return size.join(files, "track").select("track", "n", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"with {SIGNAL}, {_PCM16} select track, left(sha256(unhex(hex)), 16) as pcm16 from body")
def pcm16_hash(spark, sf_dir):
    """Fingerprints of the tracks' samples."""
    return blocks.fingerprints(blocks.to_blocks(_small(spark, sf_dir), 4096))


A, B, LONGEST = START + 5 * 86400, START + 5 * 86400 + 7200, 60.0 * 1000


@query(f"""with {NOTES} select id, pitch, round_even(start, 3) as start, round_even("end", 3) as "end" from notes where "end" >= {A} and start <= {B}""")
def visible_notes(spark, sf_dir):
    held = notes(spark, sf_dir)
    longest = held.agg(F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0.0)).alias("longest"))  # one row
    return intervals.visible(held.join(F.broadcast(longest), F.lit(True)), A, B, F.col("longest")).select("id", "pitch", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"))


@query(f"""with {NOTES} select id, pitch, round_even(start, 3) as start, round_even("end", 3) as "end" from notes where "end" >= {A} and start <= {B}""")
def indexed_view(spark, sf_dir):
    """The notes that touch a view, from an index of all notes that is written to the shared folder."""
    path = f"{lineage.shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    views.index(notes(spark, sf_dir).select("id", "pitch", "start", "end"), path, 86400.0)
    seen = views.viewed(spark.read.parquet(path), A, B, 86400.0)
    return seen.select("id", "pitch", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"))


@query(f"with {NOTES} select id, pitch, conf from notes order by conf desc, id limit 1500")
def top_conf_notes(spark, sf_dir):
    return intervals.most_confident(notes(spark, sf_dir), 1500).select("id", "pitch", "conf")


def _sides(spark, sf_dir):
    return notes(spark, sf_dir).where("id % 2 = 0"), notes(spark, sf_dir).where("id % 2 = 1")


_MATCHED = f"""{NOTES}, r as (select *, row_number() over (partition by track order by start, id) as k from notes where id % 2 = 0), e as (select * from notes where id % 2 = 1),
 c as (select r.track, k, e.id as est, e.start as s, least(e."end", r."end") - greatest(e.start, r.start) as overlap from r join e on r.track = e.track
   and abs(e.pitch - r.pitch) <= 12 and abs(e.start - r.start) <= 3600 and least(e."end", r."end") > greatest(e.start, r.start)),
 g(track, k, pick, taken) as (select distinct track, 0::bigint, null::bigint, []::bigint[] from r union all
   select track, k, pick, case when pick is null then taken else list_append(taken, pick) end from (select g.track, g.k + 1 as k, g.taken,
     (select arg_min(c.est, row(-c.overlap, c.s, c.est)) from c where c.track = g.track and c.k = g.k + 1 and not list_contains(g.taken, c.est)) as pick
     from g where exists (select 1 from r where r.track = g.track and r.k = g.k + 1))),
 m as (select g.track, r.id as ref_id, pick as est_id from g join r on r.track = g.track and r.k = g.k where pick is not null)"""


@query(f"with recursive {_MATCHED} select track, ref_id, est_id from m")
def note_match(spark, sf_dir):
    """Greedy matching of even and odd events."""
    return matching.match(*_sides(spark, sf_dir), 12.0, 3600.0)


@query(f"""with recursive {_MATCHED}, t as (select track, count(*) filter (id % 2 = 0) as r, count(*) filter (id % 2 = 1) as e from notes group by track),
 s as (select t.track, coalesce(n / nullif(e, 0)::double, 0.0) as p, coalesce(n / nullif(r, 0)::double, 0.0) as q from t left join (select track, count(*) as n from m group by track) using (track))
 select track, round_even(p, 6) as precision, round_even(q, 6) as recall, round_even(coalesce(2 * p * q / nullif(p + q, 0), 0.0), 6) as f1 from s""")
def note_match_prf(spark, sf_dir):
    return intervals.scores(*_sides(spark, sf_dir), matching.match(*_sides(spark, sf_dir), 12.0, 3600.0))


_NAMES = "['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']"


@query(f"with {NOTES} select pitch, {_NAMES}[pitch % 12 + 1] || (pitch // 12 - 1) as name, round_even(440 * pow(2.0, (pitch - 69) / 12.0), 6) as hz, pitch % 12 in (1, 3, 6, 8, 10) as black, count(*) as n from notes group by pitch")
def note_names(spark, sf_dir):
    held = notes(spark, sf_dir).groupBy("pitch").agg(F.count("*").alias("n"))
    p = F.col("pitch")
    return held.select("pitch", S.note_name(p).alias("name"), F.bround(S.midi_to_hz(p), 6).alias("hz"), S.is_black_key(p).alias("black"), "n")


@query("""select page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'track') as slug, coalesce(nullif(regexp_extract(replace(url, '\\', '/'), '([^/]*)$', 1), ''), 'upload') as name from pages""")
def slug(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", S.slug(url).alias("slug"), S.base_name(url).alias("name"))


@query("""select event_id, left(sha256('{"event_type":' || to_json(event_type) || ',"user_id":' || user_id || '}'), 16) as key from events""")
def params_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", store.row_key("user_id", "event_type").alias("key"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 8")
def keep_newest(spark, sf_dir):
    return store.newest(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("select distinct event_type from events where event_type not in ('click', 'view')")
def unknown_names(spark, sf_dir):
    registry = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return store.unknown(read(spark, sf_dir, "events"), registry, "event_type")


@query("""select event_id, lpad((floor(ms)::bigint // 60000)::varchar, 2, '0') || ':' || lpad((floor(ms)::bigint // 1000 % 60)::varchar, 2, '0') || ':' || lpad((floor(ms)::bigint % 1000)::varchar, 3, '0') as clock, round_even(ms / 1000 - 2.5, 6) as seconds,
  round_even(pow(10.0, value / 2000), 6) as gain from (select event_id, value, value * 1000 as ms from events)""")
def clock(spark, sf_dir):
    ms = F.col("value") * 1000
    return read(spark, sf_dir, "events").select("event_id", S.clock_text(ms).alias("clock"), F.bround(S.media_seconds(ms, -2.5, 0), 6).alias("seconds"), F.bround(S.gain(F.col("value") / 100), 6).alias("gain"))


@query("""select event_id, round_even(case when p < 10 + 0.05 * 40 or p > 50 - 0.15 * 40 then least(greatest(p - 0.1 * 40, 0.0), 100.0 - 40) else 10.0 end, 6) as start from (select event_id, value as p from events)""")
def follow_view(spark, sf_dir):
    at = S.follow_start(F.col("value"), F.lit(10.0), F.lit(40.0), F.lit(0.0), F.lit(100.0))
    return read(spark, sf_dir, "events").select("event_id", F.bround(at, 6).alias("start"))
