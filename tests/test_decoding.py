"""Decoding by chunks against the path of a whole track; reading MIDI; an index of intervals; the lines of both presets."""

import dataclasses
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from resona.operators import analysis, decoding, intervals, views
from resona.sources import media

FEW = dataclasses.replace(intervals.PRESETS["lead"], low=60, high=73, pitch_cost=1.0, octave_cost=3.0, rest_in=2.0, rest_out=2.0, rest_stay=0.25, rest_emission=0.5)


def salient(spark, tracks):
    held = [(t, int(f), [float(x) for x in row]) for t, (frames, m) in tracks.items() for f, row in zip(frames, m, strict=True)]
    return spark.createDataFrame(held, "track string, frame long, s array<double>").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_chunks_give_the_path_of_the_whole_track_ties_included(spark, size):
    """Quarters make many ties, and sums of them are exact in both forms."""
    random = np.random.default_rng(3)
    tracks = {
        "ties": (np.arange(300), random.integers(0, 5, (300, 14)) / 4),
        "gaps": (np.sort(random.choice(4000, 120, replace=False)), random.integers(0, 3, (120, 14)) / 2),
        "one": (np.array([17]), np.full((1, 14), 0.5)),
        "rest": (np.arange(90), np.zeros((90, 14))),
        "held": (np.arange(200), np.eye(14)[np.arange(200) // 40]),
    }
    held = salient(spark, tracks)
    expected = intervals.decode(held, 0.25, FEW).toPandas().sort_values(["track", "frame"])
    got = decoding.decode_chunks(held, 0.25, FEW, size).toPandas().sort_values(["track", "frame"])
    assert got.values.tolist() == expected.values.tolist()
    assert len(set(expected["state"])) > 4


def test_one_long_track_is_in_many_tasks(spark):
    """No group has more frames than a chunk, and random costs give the path of the whole track too."""
    m = np.random.default_rng(5).random((5000, 14))
    held = salient(spark, {"a": (np.arange(5000), m)})
    path = decoding.decode_chunks(held, 0.02, FEW, 256)
    assert [r.state for r in path.orderBy("frame").collect()] == [r.state for r in intervals.decode(held, 0.02, FEW).orderBy("frame").collect()]


def test_no_frames_no_path_and_tracks_may_be_structs(spark):
    held = salient(spark, {"a": (np.arange(3), np.eye(14)[:3])})
    assert decoding.decode_chunks(held.where("frame < 0"), 0.25, FEW).count() == 0
    named = held.withColumn("track", F.struct(F.col("track").alias("name"), F.lit(None).cast("int").alias("side")))
    assert decoding.decode_chunks(named, 0.25, FEW, 2).select("track.name", "frame").count() == 3
    assert decoding.decode_chunks(held.withColumn("track", F.lit(None).cast("string")), 0.25, FEW, 2).count() == 3
    with pytest.raises(ValueError, match="one frame"):
        decoding.decode_chunks(held, 0.25, FEW, 0)


def midi_file(*tracks: bytes, division=480, other=b""):
    chunks = b"".join(b"MTrk" + struct.pack(">I", len(t)) + t for t in tracks)
    return b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), division) + other + chunks


def tempo(us):
    return b"\0\xff\x51\x03" + us.to_bytes(3, "big")


END = b"\0\xff\x2f\0"


def test_an_off_ends_every_open_note_of_its_pitch():
    track = b"\0\x90\x3c\x40" + b"\x60\x90\x3c\x40" + b"\x60\x80\x3c\0" + b"\x60\x80\x3c\0" + END
    step = 96 * 0.5 / 480
    assert media.midi_notes(midi_file(track)) == [(60, 0.0, 2 * step), (60, step, 2 * step)]


def test_running_status_and_a_note_on_of_no_velocity_end_notes():
    track = b"\0\x90\x3c\x40" + b"\x60\x3e\x40" + b"\x60\x3c\0" + b"\x60\x3e\0" + END
    step = 96 * 0.5 / 480
    assert media.midi_notes(midi_file(track)) == [(60, 0.0, 2 * step), (62, step, 288 * 0.5 / 480)]


def test_the_tempo_is_the_first_of_the_first_track():
    note = b"\0\x90\x3c\x40" + b"\x60\x80\x3c\0" + END
    assert media.midi_notes(midi_file(tempo(250_000) + tempo(900_000) + END, tempo(800_000) + note))[0][2] == 96 * 0.25 / 480
    assert media.midi_notes(midi_file(END, tempo(800_000) + note))[0][2] == 96 * 0.5 / 480
    strange = b"XXXX" + struct.pack(">I", 3) + b"abc"
    assert media.midi_notes(midi_file(tempo(250_000) + note, other=strange))[0][2] == 96 * 0.25 / 480
    assert media.midi_notes(midi_file(b"\0\x90\x3c\x40" + END)) == [] and media.midi_notes(midi_file()) == []


def test_midi_files_are_read_from_a_folder(spark, tmp_path):
    note = b"\0\x90\x3c\x40" + b"\x60\x80\x3c\0" + END
    (tmp_path / "a.mid").write_bytes(midi_file(note))
    (tmp_path / "b.mid").write_bytes(midi_file(END, note + END))
    (tmp_path / "c.mid").write_bytes(midi_file(END))
    got = media.read_midi(spark, str(tmp_path)).orderBy("track").collect()
    assert [(r.track[-5:], r.pitch, r.start, r.end) for r in got] == [("a.mid", 60, 0.0, 96 * 0.5 / 480), ("b.mid", 60, 0.0, 96 * 0.5 / 480)]
    with pytest.raises(media.UnsupportedFormat):
        media.midi_notes(b"RIFF....")


def test_a_view_reads_the_cells_it_meets(spark, tmp_path):
    """Notes of a tenth to a hundred thousand seconds, bounds on borders of cells, repeated rows, nulls and reversed ones."""
    random = np.random.default_rng(8)
    start = np.round(random.random(600) * 2000 - 200, 1)
    length = np.round(10 ** (random.random(600) * 6 - 1), 1)
    held = [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(start, length))]
    held += [(600, 100.0, 110.0), (600, 100.0, 110.0), (601, 110.0, 110.0), (602, None, 5.0), (603, 105.0, None), (604, 108.0, 104.0), (605, 95.0, 100.0)]
    path = str(tmp_path / "index")
    views.index(spark.createDataFrame(held, "id long, start double, end double"), path, 10.0)
    table = spark.read.parquet(path)
    assert table.groupBy("id").count().where("count > 2 and id <> 600").count() == 0
    for a, b in [(100.0, 110.0), (-50.0, -49.0), (0.0, 1500.0), (99.95, 100.0), (1e7, 2e7)]:
        expected = sorted(i for i, s, e in held if s is not None and e is not None and s <= e and s <= b and e >= a)
        assert sorted(r.id for r in views.viewed(table, a, b, 10.0).collect()) == expected
    narrow = views.viewed(table, 100.0, 101.0, 10.0)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    cells = {(r.level, r.cell) for r in table.select("level", "cell").distinct().collect()}
    size = lambda level: 10.0 * 2**level
    met = {(k, c) for k, c in cells if c * size(k) <= 101.0 and (c + 1) * size(k) > 100.0}
    assert len(met) < len(cells) / 4
    with pytest.raises(ValueError, match="width"):
        views.index(table, str(tmp_path / "no"), 0.0)


def test_an_empty_index_has_no_view(spark, tmp_path):
    path = str(tmp_path / "none")
    views.index(spark.createDataFrame([], "id long, start double, end double"), path, 10.0)
    table = spark.read.schema("id long, start double, end double, level int, cell long").parquet(path)
    assert views.viewed(table, 0.0, 1.0, 10.0).count() == 0


def line(notes, rate, seconds):
    """Stacks of harmonics that rise and fall within a tenth of a second."""
    out = np.zeros(int(seconds * rate))
    for pitch, start, length in notes:
        t = np.arange(int(length * rate)) / rate
        f = 440 * 2 ** ((pitch - 69) / 12)
        shape = np.minimum(np.minimum(t / 0.1, (length - t) / 0.1), 1)
        out[int(start * rate) : int(start * rate) + len(t)] += shape * sum(np.sin(2 * np.pi * k * f * t) / k for k in range(1, 9) if k * f < rate / 2)
    return out / np.abs(out).max() * 0.9


# Pitches of two lines (fixed values).
BASS_PITCHES = [45, 48, 50, 45, 43]
LEAD_PITCHES = [60, 64, 67, 72, 69, 65, 62, 59, 55, 52, 48, 50, 53, 57, 60, 64, 69, 72, 76, 79, 81, 84]


@pytest.mark.parametrize(("name", "notes"), [("bass", [(p, 0.5 + 0.9 * i, 0.5) for i, p in enumerate(BASS_PITCHES)]), ("lead", [(p, 0.2 + 0.65 * i, 0.5) for i, p in enumerate(LEAD_PITCHES)])])
def test_both_presets_find_every_note_of_their_line_and_no_other(spark, name, notes):
    """Five low notes, and 22 from 48 to 84, at a tolerance of 0.15 s."""
    x = line(notes, 22050, notes[-1][1] + 1)
    pcm = spark.createDataFrame(pd.DataFrame({"track": "a", "n": np.arange(len(x)), "v": x})).withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1))))
    reference = spark.createDataFrame([(i, "a", p, s, s + d) for i, (p, s, d) in enumerate(notes)], "id long, track string, pitch int, start double, end double")
    scored = analysis.evaluate(pcm, reference, intervals.preset_of(name), 22050, 8192, 2048, tolerance=0.15).first()
    assert (scored.recall, scored.precision) == (1.0, 1.0)
