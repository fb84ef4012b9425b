"""Operators against numpy and against what is known of made-up signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from resona.functions import scalars as S
from resona.operators import analysis, blocks, intervals, matching, rhythm, separation, spectral, store, transform
from resona.sources import media


NOTES = "id long, track string, pitch int, start double, end double, conf double"


def samples(spark, values, track="a"):
    return spark.createDataFrame(pd.DataFrame({"track": track, "n": np.arange(len(values)), "v": np.asarray(values, float)}))


def matrix(spark, m, track="a"):
    return spark.createDataFrame([(track, i, [float(x) for x in row]) for i, row in enumerate(m)], "track string, frame long, m array<double>")


def test_transform_equals_numpy(spark):
    x = np.random.default_rng(42).normal(0, 0.2, 50)
    win, hop = 16, 4
    padded = np.concatenate([np.zeros(8), x, np.zeros(8)])
    padded = np.concatenate([padded, np.zeros(-(len(padded) - win) % hop % win)])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    expected = [np.fft.rfft(padded[i : i + win] * w) / w.sum() for i in range(0, len(padded) - win + 1, hop)]
    got = spectral.dft(samples(spark, x), win, hop).orderBy("frame").collect()
    assert len(got) == len(expected)
    for r, e in zip(got, expected, strict=True):
        assert np.allclose(np.array(r.re) + 1j * np.array(r.im), e, atol=1e-12)


@pytest.mark.parametrize("win", [8, 16, 32])
def test_round_trip(spark, win):
    x = np.sin(np.arange(90) / 5)
    held = samples(spark, x)
    sizes = held.groupBy("track").agg((F.max("n") + 1).alias("samples"))
    back = spectral.inverse(spectral.dft(held, win), sizes, win).orderBy("n").toPandas()["v"].to_numpy()
    assert 20 * np.log10(np.linalg.norm(x) / np.linalg.norm(back - x)) > 60


def test_bands_have_nearest_bin_where_none_is_inside():
    found = spectral.bands(64, 126, 8000)
    assert len(found) == 88 and found[0] == (0, 0, 1) and all(n >= 1 for _, _, n in found)
    assert sum(n for row, _, n in found if row > 60) > 27


def test_widen_keeps_the_total_and_one_is_identity(spark):
    x = np.random.default_rng(0).random(440)
    held = spark.createDataFrame([([float(v) for v in x],)], "p array<double>")
    wide = np.array(held.select(spectral.widen(F.col("p"), 440, 5)).first()[0])
    assert abs(wide.sum() / x.sum() - 1) < 5e-3
    assert np.allclose(held.select(spectral.widen(F.col("p"), 440, 1)).first()[0], x)


def test_pool_keeps_maxima_and_is_identity_below_the_cap(spark):
    m = np.random.default_rng(1).random((30, 8))
    held = matrix(spark, m)
    top = spectral.pool(held, 10, "m").agg(F.max("p")).first()[0]
    assert top == m.max() and spectral.pool(held, 100, "m").count() == m.size


def test_silence_raises(spark):
    with pytest.raises(Exception, match="silent"):
        spectral.quantised(spectral.pool(matrix(spark, np.zeros((3, 2))), 10, "m")).collect()


@pytest.mark.parametrize("values,top", [([0, 1, 4, 5, 4, 1, 0], 5.0), ([9, 1, 2, 0.5, 9], 2.0)])
def test_parabola(spark, values, top):
    held = spark.createDataFrame([tuple(map(float, values[i - 1 : i + 2])) for i in range(1, len(values) - 1)], "a double, b double, c double")
    offset, height = spectral.parabolic(*(F.col(c) for c in "abc"))
    r = held.where("b > a and b > c").select(offset, height).first()
    assert abs(r[0]) <= 0.5 and r[1] >= top


def test_median_masks_need_odd_windows_and_equal_numpy(spark):
    m = np.random.default_rng(3).random((12, 9))
    with pytest.raises(ValueError):
        separation.medians(matrix(spark, m), 30, 31)
    for block in (4, 256):
        got = separation.medians(matrix(spark, m), 5, 3, block).orderBy("frame").toPandas()
        assert len(got) == 12 and np.allclose(np.stack(got["m"]), m)
    wide = np.pad(m, ((2, 2), (1, 1)))
    h = [np.median(wide[f : f + 5, b + 1]) for f in range(12) for b in range(9)]
    p = [np.median(wide[f + 2, b : b + 3]) for f in range(12) for b in range(9)]
    assert np.allclose(np.concatenate(list(got["h"])), h) and np.allclose(np.concatenate(list(got["p"])), p)


def test_thin_keeps_the_earlier_peak(spark):
    held = spark.createDataFrame([("a", f) for f in (1, 3, 5, 6, 11, 12)], "track string, frame long")
    assert sorted(r.frame for r in rhythm.thin(held, 4).collect()) == [1, 5, 11]


def test_tempo_of_clicks(spark):
    hop = 0.05
    series = spark.createDataFrame([("a", t, 1.0 if t % 10 == 3 else 0.0) for t in range(240)], "track string, t long, x double")
    found = rhythm.tempo(rhythm.autocorrelation(series, 48), hop)
    assert 105 <= found.first().bpm <= 135
    offset = rhythm.phase(series, found, hop).first().offset
    assert abs(offset - 0.15) < 0.03


def test_decode_is_the_cheapest_path(spark):
    preset = intervals.Preset(60, 62, (0, 1), 1, 0.0, 1.2, 3.0, 2.5, 2.5)
    s = np.random.default_rng(5).random((6, 3))
    held = spark.createDataFrame([("a", i, [float(x) for x in row]) for i, row in enumerate(s)], "track string, frame long, s array<double>")
    got = [r.state for r in intervals.decode(held, 0.1, preset).orderBy("frame").collect()]
    cost = intervals.transition_costs(3, 0.1, preset)
    e = np.concatenate([1 - s, np.full((6, 1), preset.rest_emission)], axis=1)
    total = lambda p: sum(e[i, x] for i, x in enumerate(p)) + sum(cost[a, b] for a, b in zip(p, p[1:], strict=False))
    best = min(np.ndindex(*(4,) * 6), key=total)
    assert abs(total(got) - total(best)) < 1e-12




def test_poly_merge_is_strict_and_by_pitch(spark):
    rows = [(60, 0, 0.25), (61, 0.25, 0.5), (60, 0.3125, 0.5), (60, 0.5625, 0.75), (60, 0.78125, 0.875)]
    held = spark.createDataFrame([(i, "a", p, float(a), float(b), 0.1 * i) for i, (p, a, b) in enumerate(rows)], NOTES)
    got = sorted((r.pitch, r.start, r.end) for r in intervals.merge_poly(held, 0.0625).collect())
    assert got == [(60, 0.0, 0.25), (60, 0.3125, 0.5), (60, 0.5625, 0.875), (61, 0.25, 0.5)]


def test_mono_merge_looks_at_the_segment_before_whatever_its_pitch(spark):
    held = spark.createDataFrame([("a", 1, 0, 5), ("a", 2, 6, 8), ("a", 1, 9, 12), ("a", 1, 13, 15)], "track string, state int, f0 long, f1 long")
    got = sorted((r.f0, r.f1) for r in intervals.merge_mono(held, 0.03).collect())
    assert got == [(0, 5), (6, 8), (9, 15)]


def test_decoding_in_batches_is_the_whole_path(spark):
    """Long tracks in small batches, against the textbook recursion."""
    preset = intervals.PRESETS["bass"]
    n, rng = preset.high - preset.low + 1, np.random.default_rng(6)
    tracks = {t: rng.random((k, n)) ** 4 for t, k in (("a", 700), ("b", 3), ("c", 1), ("d", 250))}
    tracks["e"] = np.zeros((400, n))
    held = spark.createDataFrame([(t, i, [float(x) for x in row]) for t, m in tracks.items() for i, row in enumerate(m)], "track string, frame long, s array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = intervals.decode(held.repartition(5), 0.02, preset).toPandas().sort_values(["track", "frame"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cost = intervals.transition_costs(n, 0.02, preset)
    for t, m in tracks.items():
        e = np.concatenate([1 - m, np.full((len(m), 1), preset.rest_emission)], axis=1)
        total, back = e[0], []
        for row in e[1:]:
            through = total[:, None] + cost
            back.append(through.argmin(axis=0))
            total = through.min(axis=0) + row
        path = [int(total.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        own = got[got["track"] == t]
        assert own["frame"].tolist() == list(range(len(m))) and own["state"].tolist() == path[::-1]


def test_segments_that_snap_to_the_same_bounds_stay_two(spark):
    salient = spark.createDataFrame([("a", i, [0.2 * (i + 1)]) for i in range(4)], "track string, frame long, s array<double>")
    segments = spark.createDataFrame([("a", 0, 1, 0, 3), ("a", 0, 2, 0, 3)], "track string, state int, id int, f0 long, f1 long")
    assert [r.conf for r in intervals.confidences(segments, salient).collect()] == [0.4, 0.4]


def test_smoothing_in_blocks_is_the_whole_fold(spark):
    x = np.random.default_rng(2).random(100)
    held = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "track string, t int, x double")
    for keep in (0.7, 0.999):
        for block in (3, 40, 4096):
            got = [r.smooth for r in rhythm.smoothed(held, "t", "x", keep, block).orderBy("t").collect()]
            last, out = x[0], []
            for i, v in enumerate(x):
                last = v if i == 0 else keep * last + (1 - keep) * v
                out.append(last)
            assert np.allclose(got, out, atol=1e-12)


def test_silence_and_short_series_have_the_default_tempo(spark):
    rows = [("flat", t, 0.0) for t in range(200)] + [("short", t, float(t % 5 == 0)) for t in range(63)] + [("clicks", t, float(t % 10 == 3)) for t in range(240)]
    got = {r.track: (r.bpm, r.offset) for r in rhythm.estimate(spark.createDataFrame(rows, "track string, t long, x double"), 0.05).collect()}
    assert got["flat"] == got["short"] == (120.0, 0.0) and 105 <= got["clicks"][0] <= 135 and abs(got["clicks"][1] - 0.15) < 0.03


def pcm_of(spark, left, right, track="a"):
    rows = [(track, ch, i, float(v)) for ch, x in enumerate((left, right)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "track string, ch int, n long, v double")


def test_analysis_of_clicks(spark):
    """Twelve seconds at 120 beats a minute: the tempo, the shapes, and every channel on the scale of the loudest."""
    import base64
    import json

    rate, x = 8000, np.zeros(12 * 8000)
    burst = np.sin(2 * np.pi * 1000 * np.arange(400) / rate) * np.exp(-np.arange(400) / 80)
    for k in range(24):
        x[k * 4000 : k * 4000 + 400] += burst
    held = pcm_of(spark, x, x / 4)
    got = json.loads(analysis.analyse(held, rate, 512, columns=180).first().payload)
    assert 105 <= got["bpm"] <= 135 and 0 <= got["beatOffsetSec"] < 60 / got["bpm"] and got["durationSec"] == 12.0
    cells = {c: np.frombuffer(base64.b64decode(s), np.uint8).reshape(88, got["nCols"]) for c, s in got["specs"].items()}
    assert set(cells) == {"mix", "left", "right"} and cells["left"].max() == 255 > cells["mix"].max() > cells["right"].max()
    assert got["envelopes"]["left"] == cells["left"].max(axis=0).tolist()
    assert got["notes"] is None and got["noteLabels"][0] == "A0" and (got["rate"], got["sub"]) == (15, 1)
    assert analysis.checked(5, 3) == (15, 1) and analysis.checked(99, 10) == (60, 10)
    with pytest.raises(Exception, match="silent"):
        analysis.analyse(pcm_of(spark, np.zeros(4000), np.zeros(4000)), rate, 512).collect()


def line(notes, rate, seconds):
    """Harmonic notes (pitch, start, length) with soft ends."""
    out = np.zeros(int(seconds * rate))
    for pitch, start, length in notes:
        t = np.arange(int(length * rate)) / rate
        f = 440 * 2 ** ((pitch - 69) / 12)
        shape = np.minimum(np.minimum(t / 0.1, (length - t) / 0.1), 1)
        at = int(start * rate)
        out[at : at + len(t)] += shape * sum(np.sin(2 * np.pi * k * f * t) / k for k in range(1, 9) if k * f < rate / 2)
    return out / np.abs(out).max() * 0.9


BASS = [(45, 0.5, 0.5), (48, 1.4, 0.5), (50, 2.3, 0.5), (45, 3.2, 0.5), (43, 4.1, 0.5)]
LEAD = [(60 + [0, 4, 7, 12][i % 4], 0.2 + 0.65 * i, 0.5) for i in range(10)]


@pytest.mark.parametrize(("name", "notes"), [("bass", BASS), ("lead", LEAD)])
def test_transcription_finds_every_note_and_no_other(spark, name, notes):
    """From samples to notes, with recall and precision of 1 at a tolerance of a tenth of a second."""
    rate = 22050
    x = line(notes, rate, notes[-1][1] + 1)
    preset = intervals.preset_of(name)
    win, hop = 8192, 441
    reference = spark.createDataFrame([(i, "a", p, s, s + d, 1.0) for i, (p, s, d) in enumerate(notes)], NOTES)
    scored = analysis.evaluate(pcm_of(spark, x, x), reference, preset, rate, win, hop, tolerance=0.2).first()
    assert (scored.recall, scored.precision) == (1.0, 1.0)


def test_presets_and_selections(spark):
    assert intervals.names_of("both") == ["bass", "lead"] and intervals.names_of("lead") == ["lead"]
    with pytest.raises(KeyError, match="none of"):
        intervals.names_of("drums")
    assert {r.name for r in intervals.presets(spark).collect()} == {"bass", "lead"}
    notes = spark.createDataFrame([("bass", 1), ("lead", 2), ("other", 3)], "preset string, id int")
    assert sorted(r.id for r in intervals.selected(notes, "both").collect()) == [1, 2] and intervals.selected(notes, "bass").first().id == 1


def test_a_model_of_notes_is_run_by_chunk_and_merged(spark):
    x = np.zeros(60)
    x[10:50] = 1.0
    held = samples(spark, x)
    plan = separation.chunks(held.groupBy("track").agg((F.max("n") + 1).alias("total")), separation.pulled_back(F.col("total"), 20, 4))
    run = lambda v: [(60, float(np.flatnonzero(v)[0]), float(np.flatnonzero(v)[-1] + 1), 0.5)] if v.any() else []
    got = intervals.predicted_notes(separation.spread(held, plan, 20), run, 1.0, 2.0).collect()
    assert [(r.track, r.pitch, r.start, r.end, r.conf) for r in got] == [("a", 60, 10.0, 50.0, 0.5)]


def test_scores_and_their_mean(spark):
    note = lambda *rows: spark.createDataFrame([(i, t, 60, float(i), i + 0.5, 0.5) for i, t in rows], NOTES)
    ref, est = note((0, "a"), (1, "a"), (2, "b")), note((0, "a"), (7, "a"), (8, "c"))
    scored = intervals.scores(ref, est, matching.match(ref, est))
    assert {r.track: (r.precision, r.recall, r.f1) for r in scored.collect()} == {"a": (0.5, 0.5, 0.5), "b": (0, 0, 0), "c": (0, 0, 0)}
    assert tuple(intervals.mean_scores(scored).first()) == (3, round(0.5 / 3, 6), round(0.5 / 3, 6), round(0.5 / 3, 6))


def test_midi_file_round_trip(spark):
    held = spark.createDataFrame([(1, "bass", 45, 0.5, 1.0, 0.9), (2, "bass", 48, 1.4, 2.0, 0.5)], NOTES)
    events = intervals.deltas(intervals.midi_events(held, 120.0, 0.0)).withColumn("file", F.lit("x"))
    data = bytes(media.one_midi(events, "file", 120.0).first().content)
    assert data[8:10] == b"\0\0"
    got = media.midi_notes(data)
    assert [(p, round(a, 2), round(b, 2)) for p, a, b in got] == [(45, 0.5, 1.0), (48, 1.4, 2.0)]


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(1000) / 9) * 0.5
    (tmp_path / "a.wav").write_bytes(media.wav_bytes(np.stack([x, np.roll(x, 3)], axis=1), 8000))
    held = media.read_wav(spark, str(tmp_path))
    left = held.where("ch = 0").orderBy("n").toPandas()
    assert len(left) == 1000 and left["rate"].iloc[0] == 8000 and np.abs(left["v"] - x).max() < 1e-3
    mix = blocks.channels(blocks.to_blocks(held, by=("track", "ch"))).where("channel = 'mix'")
    assert blocks.samples(mix).count() == 1000
    with pytest.raises(media.UnsupportedFormat):
        media.wav_samples(b"nothing")
    with pytest.raises(ValueError, match="after the end"):
        media.wav_samples(media.wav_bytes(x, 8000), start=5.0)


def test_a_wav_file_too_large_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.wav").write_bytes(media.wav_bytes(np.zeros(100), 8000))
    (tmp_path / "b.wav").write_bytes(media.wav_bytes(np.zeros(1000), 8000))
    monkeypatch.setattr(media, "LARGEST", 1000)
    with pytest.raises(media.TooLarge, match="b.wav has 2044 bytes"):
        media.read_wav(spark, str(tmp_path), end=0.01)
    monkeypatch.setattr(media, "LARGEST", 2044)
    assert media.read_wav(spark, str(tmp_path)).count() == 1100


def test_fingerprint(spark):
    import hashlib

    x = np.linspace(-1.2, 1.2, 40)
    expected = hashlib.sha256((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()).hexdigest()[:16]
    assert blocks.fingerprints(blocks.to_blocks(samples(spark, x), 16)).first().pcm16 == expected


def test_plans(spark):
    def plan(total, chunk, overlap, f=separation.pulled_back):
        held = spark.createDataFrame([("a", total)], "track string, total long")
        return [(r.start, r.end) for r in separation.chunks(held, f(F.col("total"), chunk, overlap)).orderBy("chunk").collect()]

    assert plan(0, 10, 2) == [] and plan(5, 10, 2) == [(0, 5)] and plan(10, 10, 2) == [(0, 10)] and plan(11, 10, 2) == [(0, 10), (1, 11)]
    assert plan(25, 10, 4) == [(0, 10), (6, 16), (12, 22), (15, 25)]
    cut = lambda total, chunk, overlap: plan(total, chunk, overlap, separation.clipped)
    assert cut(50, 20, 5) == [(0, 20), (15, 35), (30, 50), (45, 50)] and cut(16, 20, 5) == [(0, 16), (15, 16)]
    assert cut(100, 50, 10) == [(0, 50), (40, 90), (80, 100)] and cut(120, 50, 10)[-1] == (80, 120)
    with pytest.raises(ValueError):
        separation.pulled_back(F.lit(1), 10, 10)
    with pytest.raises(ValueError):
        separation.clipped(F.lit(1), 10, 0)


@pytest.mark.parametrize("scale", [1.0, 1e-4])
@pytest.mark.parametrize("shape", [(120, 100), (90, 140)])
def test_low_rank_recovery(scale, shape):
    """A plane of rank 3 under strong single cells, with the defaults."""
    rng = np.random.default_rng(11)
    plane = scale * sum(np.outer(rng.normal(size=shape[0]), rng.normal(size=shape[1])) for _ in range(3))
    spikes = np.zeros(shape)
    at = rng.choice(plane.size, plane.size * 3 // 100, replace=False)
    spikes.flat[at] = scale * rng.uniform(-15, 15, len(at))
    low, sparse = separation.low_rank(plane + spikes)
    for got, true in ((low, plane), (sparse, spikes)):
        assert np.linalg.norm(got - true) < 1e-3 * np.linalg.norm(true)


def test_low_rank_masks_are_near_those_of_a_tighter_solve():
    """Harmonics with clicks and noise: no cell of a mask moves by a twentieth, and the mean by far less; the bound on rounds is not met."""
    t, f = np.arange(400)[:, None], np.arange(513)[None, :]
    m = sum(np.exp(-(((f - 40 * k) / 1.5) ** 2)) * (1 + 0.3 * np.sin(t / 30 + k)) for k in range(1, 8))
    m = m + np.exp(-f / 100) * (t % 25 == 0) + np.abs(np.random.default_rng(0).normal(0, 0.01, m.shape))

    def share(*stop):
        low, sparse = separation.low_rank(m, *stop)
        return low**2 / (low**2 + sparse**2 + 1e-10)

    usual, tight = share(), share(60, 1e-9)
    assert np.abs(usual - tight).max() < 0.05 and np.abs(usual - tight).mean() < 1e-3
    assert np.array_equal(usual, share(40, 1e-6))
    assert np.abs(share(100, 5e-4) - tight).mean() < 1e-2


def test_low_rank_of_silence():
    low, sparse = separation.low_rank(np.zeros((3, 4)))
    assert not low.any() and not sparse.any()


@pytest.mark.parametrize("total", [16, 50, 100])
def test_low_rank_chunks_are_cross_faded(spark, total, monkeypatch):
    """Against a loop over the chunks that blends rows one by one."""
    m, chunk, overlap = np.random.default_rng(5).random((total, 6)), 20, 5
    got = separation.low_rank_chunks(matrix(spark, m), chunk, overlap).orderBy("frame").toPandas()
    hop, out, last = chunk - overlap, np.zeros((total, 6)), None
    for a in range(0, total, hop):
        own = separation.low_rank(m[a : a + chunk])[0]
        after = min(a + hop, total)
        for n in range(a, after):
            out[n] = own[n - a]
        if last is not None:
            fade = min(overlap, len(own), len(last), after - a)
            for j in range(fade):
                w = (j + 1) / (fade + 1)
                out[a + j] = w * own[j] + (1 - w) * last[hop + j]
        last = own
    assert len(got) == total and np.abs(np.stack(got["low"]) - out).max() < 1e-9
    assert np.abs(np.stack(got["low"]) + np.stack(got["sparse"]) - m).max() < 1e-4


def test_transform_equals_numpy_at_real_windows(spark):
    x = np.random.default_rng(42).normal(0, 0.2, 9000)
    win, hop = 2048, 512
    padded = np.concatenate([np.zeros(1024), x, np.zeros(1024)])
    padded = np.concatenate([padded, np.zeros(-(len(padded) - win) % hop % win)])
    w = transform.window(win)
    expected = np.stack([np.fft.rfft(padded[i : i + win] * w) / w.sum() for i in range(0, len(padded) - win + 1, hop)])
    for block in (4, 256):
        got = transform.stft(samples(spark, x), win, hop, block).orderBy("frame").toPandas()
        assert len(got) == len(expected) and np.allclose(np.stack(got["re"]) + 1j * np.stack(got["im"]), expected, atol=1e-12)
    with pytest.raises(ValueError):
        transform.stft(samples(spark, x), 8, 8)


@pytest.mark.parametrize("block", [5, 256])
def test_signals_come_back_at_60_decibels(spark, block):
    rate = 22050
    t = np.arange(rate) / rate
    for x in (0.5 * np.sin(2 * np.pi * 440 * t), 0.5 * np.sin(2 * np.pi * (100 * t + 1950 * t * t)), np.random.default_rng(42).normal(0, 0.2, rate)):
        held = samples(spark, x)
        sizes = held.groupBy("track").agg((F.max("n") + 1).alias("samples"))
        back = transform.istft(transform.stft(held, 2048, 512, block), sizes, 2048, 512, block).orderBy("n").toPandas()
        assert back["n"].tolist() == list(range(rate))
        assert 20 * np.log10(np.linalg.norm(x) / np.linalg.norm(back["v"] - x)) >= 60


def test_stems_add_up_and_tell_tone_from_clicks(spark):
    rate = 8000
    t = np.arange(2 * rate) / rate
    tone = 0.4 * np.sin(2 * np.pi * (400 * t + 75 * t * t))
    clicks = np.where(np.arange(len(t)) % 2400 == 1200, 0.9, 0.0)
    held = samples(spark, tone + clicks)
    for method, sizes in (("hpss", {"time": 17, "freq": 17}), ("rpca", {"chunk": 40, "overlap": 8}), ("combined", {"time": 17, "freq": 17, "chunk": 40, "overlap": 8})):
        got = separation.separate(held, method, 512, 128, **sizes).toPandas()
        one, two = (got[got["stem"] == s].sort_values("n")["v"].to_numpy() for s in separation.stems_of(method))
        assert len(one) == len(two) == len(t) and np.abs(one + two - tone - clicks).max() < 1e-3
        if method == "hpss":
            near = clicks > 0
            assert np.abs(two[near]).mean() > 3 * np.abs(one[near] - tone[near]).mean()
            assert np.corrcoef(one, tone)[0, 1] > 0.95
    with pytest.raises(ValueError, match="none of"):
        separation.separate(held, "magic", 512)


def test_a_model_sees_whole_chunks_in_order(spark):
    """Reversal and a running sum depend on every sample of a chunk and its order."""
    x = np.random.default_rng(3).random(100)
    held = samples(spark, x).repartition(7)
    sizes = held.groupBy("track").agg((F.max("n") + 1).alias("total"))
    plan = separation.chunks(sizes, separation.pulled_back(F.col("total"), 40, 20))
    seen = lambda v: np.stack([v[::-1], np.cumsum(v)])[:, None, :]
    parts = separation.infer_chunks(held, plan, 40, seen, ("back", "sum"))
    got = separation.blended(parts, ("track", "stem")).toPandas()
    total, weight = np.zeros((2, 100)), np.zeros(100)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(40) + 0.5) / 40)
    for a in (0, 20, 40, 60):
        total[:, a : a + 40] += w * seen(x[a : a + 40])[:, 0]
        weight[a : a + 40] += w
    for k, stem in enumerate(("back", "sum")):
        assert np.allclose(got[got["stem"] == stem].sort_values("n")["v"], total[k] / weight)
    with pytest.raises(Exception, match="lacks the stems third"):
        separation.infer_chunks(held, plan, 40, seen, ("back", "sum", "third")).collect()
    short = samples(spark, x[:7])
    one = separation.chunks(short.groupBy("track").agg((F.max("n") + 1).alias("total")), separation.pulled_back(F.col("total"), 40, 20))
    got = separation.infer_chunks(short, one, 40, lambda v: v + len(v), ("all",)).orderBy("n").toPandas()
    assert np.allclose(got["y"], x[:7] + 40)
    assert separation.normalised_output([np.ones((1, 2, 5)), np.zeros((1, 2, 5))], 4).shape == (2, 4)


def test_matching_equals_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    make = lambda base: [(base + i, "a", int(rng.integers(60, 63)), float(s), float(s + 0.3), 0.5) for i, s in enumerate(np.sort(rng.random(30) * 5))]
    ref, est = make(0), make(100)
    used, expected = set(), []
    for r in ref:
        best, top = None, 0.0
        for e in est:
            overlap = min(r[4], e[4]) - max(r[3], e[3])
            if e[0] not in used and abs(e[2] - r[2]) <= 0.5 and abs(e[3] - r[3]) <= 0.2 and overlap > top:
                best, top = e[0], overlap
        if best is not None:
            used.add(best)
            expected.append((r[0], best))
    held = [spark.createDataFrame(x, NOTES) for x in (ref, est)]
    assert sorted((r.ref_id, r.est_id) for r in matching.match(*held, 0.5, 0.2).collect()) == sorted(expected)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.note_name(F.lit(60))) == "C4" and one(S.note_name(F.lit(21))) == "A0" and abs(one(S.midi_to_hz(F.lit(69))) - 440) < 1e-9
    assert one(S.quantise(F.lit(-70.0), 70.0)) == 0 and one(S.quantise(F.lit(0.0), 70.0)) == 255
    assert abs(one(S.a_weighting(F.lit(1000.0))) - 1) < 1e-12
    assert one(S.velocity(F.lit(2.0))) == 127 and one(S.fader_text(F.lit(1e-5))) == "−∞" and one(S.fader_text(F.lit(2.0))) == "+6.0"
    assert one(S.slug(F.lit("///"))) == "track" and one(S.base_name(F.lit("a\\b/c.wav"))) == "c.wav"
    assert separation.shifts("best") == 2
    with pytest.raises(ValueError):
        separation.shifts("ultra")


def test_params_key_ignores_order_and_sees_values():
    a = store.params_key({"win": 2048, "hop": 512})
    assert a == store.params_key({"hop": 512, "win": 2048}) != store.params_key({"hop": 256, "win": 2048}) and len(a) == 16


def test_store_misses_then_finds(spark, tmp_path):
    folder, calls = str(tmp_path / "kept"), []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sorted(r[0] for r in store.get(spark, folder, "k", {"a": 1}, "v1", make).select("id").collect()) == [0, 1, 2]
    assert len(calls) == 1
    assert store.find(spark, folder, "k", {"a": 1}, "v2") is None and store.find(spark, folder, "k", {"a": 2}, "v1") is None
    store.put(spark.range(2).selectExpr("'x' as other"), folder, "j", {"a": 1}, "v1")
    store.put(spark.range(5), folder, "k", {"a": 1}, "v1")
    assert store.find(spark, folder, "k", {"a": 1}, "v1").count() == 5 and store.find(spark, folder, "j", {"a": 1}, "v1").first()[0] == "x"
    assert [r.store_key for r in store.listed(spark, folder, 1).collect()] == ["k"] and store.listed(spark, folder).count() == 2
    assert store.get(spark, folder, "none", {}, "v1", lambda: spark.range(0)).count() == 0
    with pytest.raises(ValueError, match="does not name a folder"):
        store.find(spark, folder, "../k", {}, "v1")


def test_a_group_of_jobs_tells_its_progress_and_can_be_cancelled(spark):
    import time

    from pyspark import InheritableThread

    ended, context = [], spark.sparkContext

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(0 if batch.column("id")[0].as_py() < 6 else 60)
            yield batch

    def work():
        context.setJobGroup("slow", "a slow job", interruptOnCancel=True)
        try:
            ended.append(spark.range(0, 8, 1, 8).mapInArrow(slow, "id long").count())
        except Exception as e:
            ended.append(e)

    assert store.progress(spark, "slow") == 0.0
    thread, began = InheritableThread(target=work), time.monotonic()
    thread.start()
    while not 0 < store.progress(spark, "slow") < 1 and time.monotonic() - began < 40:
        time.sleep(0.1)
    assert 0 < store.progress(spark, "slow") < 1
    context.cancelJobGroup("slow")
    thread.join(40)
    assert len(ended) == 1 and isinstance(ended[0], Exception)


def test_session_columns_are_rounded_half_even():
    from pathlib import Path

    text = "".join(p.read_text() for p in Path(__file__).parents[1].joinpath("resona").rglob("*.py"))
    assert "F.round(" not in text


def test_times_as_text(spark):
    ms = F.col("ms").cast("long")
    texts = spark.createDataFrame([(-1,), (0,), (951782399999,), (1767225600007,)], "ms long").select(S.iso_text(ms).alias("t"), S.stamp_ms(S.iso_text(ms)).alias("back"), "ms").collect()
    assert [r.t for r in texts] == ["1969-12-31T23:59:59.999Z", "1970-01-01T00:00:00.000Z", "2000-02-28T23:59:59.999Z", "2026-01-01T00:00:00.007Z"]
    assert all(r.back == r.ms for r in texts)
    odd = spark.createDataFrame([("2026-01-01 00:00:00",), ("2026-01-01T00:00:00.25 Z",), ("yesterday",), ("2026-13-01 00:00:00",), (None,)], "t string")
    assert [r[0] for r in odd.select(S.stamp_ms(F.col("t"))).collect()] == [1767225600000, 1767225600250, None, None, None]


def test_ticks_and_jumps(spark):
    spans = spark.createDataFrame([(16000.0,), (16001.0,), (9600000.0,), (1e12,)], "x double")
    assert [r[0] for r in spans.select(S.tick_ms(F.col("x"))).collect()] == [1000, 2000, 600000, 600000]
    jumps = spark.createDataFrame([(5.0, -9.0), (5.0, 2.0), (5.0, 99.0)], "at double, by double")
    assert [r[0] for r in jumps.select(S.sought(F.col("at"), F.col("by"), 1.0, 60.0)).collect()] == [1.0, 7.0, 60.0]


def test_places_in_a_hot_key_are_counted_over_ranges(spark):
    """A key with nine tenths of the rows lies in several ranges, and each row has the place that sorting gives it."""
    draw = np.random.default_rng(8)
    rows = [(None if i % 50 == 0 else "hot" if i % 10 else f"k{i % 3}", int(draw.integers(0, 40)), i) for i in range(3000)]
    held = spark.createDataFrame(rows, "key string, at int, id long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one range
    try:
        got = {r.id: r.k for r in rhythm.numbered(held, "key", ("at", "id")).collect()}
        ranges = held.repartitionByRange("key", "at", "id").withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for key, at, i in rows:
        by.setdefault(key, []).append((at, i))
    assert got == {i: k for part in by.values() for k, (_, i) in enumerate(sorted(part), 1)}
    assert len({r.p for r in ranges if r.key == "hot"}) > 1
    assert rhythm.numbered(held.limit(0), "key", ("at", "id")).count() == 0


def test_names_in_order(spark):
    held = spark.createDataFrame([(["a", "b"],)], "found array<string>")
    registry = lambda *names: F.array(*map(F.lit, names))
    assert held.select(S.in_order(F.col("found"), registry("a", "b"))).first()[0] == ["a", "b"]
    for other in [("b", "a"), ("a",), ("a", "b", "c")]:
        with pytest.raises(Exception, match="expected " + ", ".join(other) + ", found a, b"):
            held.select(S.in_order(F.col("found"), registry(*other))).collect()


def test_layers_of_two_steps_meet_at_the_columns_of_a_view(spark):
    from resona.operators import views

    def shown(n, hop, offset, a, b, columns):
        out = {}
        for x in range(columns):
            c = int(np.floor((a + (x + 0.5) * (b - a) / columns - offset) / hop))
            if 0 <= c < n:
                out[x] = c
        return out

    for n, hop, offset, a, b, columns in [(20, 0.05, 0.03, 0.1, 1.0, 37), (5, 1.0, -2.0, 0.0, 10.0, 7), (400, 0.01, 0.0, 1.003, 2.0, 12), (3, 0.5, 50.0, 0.0, 1.0, 4)]:
        cells = spark.range(n).select(F.col("id").alias("col"))
        got = [(r.x, r.col) for r in views.aligned(cells, hop, a, b, columns, offset).collect()]
        assert len(got) == len(dict(got)) and dict(got) == shown(n, hop, offset, a, b, columns)
    with pytest.raises(ValueError, match="view"):
        views.aligned(cells, 0.5, 1.0, 1.0, 4)


def test_a_delta_beyond_28_bits_is_an_error():
    assert len(media.midi_bytes({"a": [((1 << 28) - 1, 1, 60, 64)]}, 120.0)) > 0
    with pytest.raises(ValueError, match="more than a file can say"):
        media.midi_bytes({"a": [(1 << 28, 1, 60, 64)]}, 120.0)
