"""Notes found in recordings against what is played in them: single lines, and a folder of many files."""

import numpy as np
import pytest

from resona.operators import analysis, blocks, evaluation, intervals, matching
from resona.sources import media

NOTES = "id long, track string, pitch int, start double, end double"

# fixed values: the lines (pitch, start, length) on which recall is 1 and nothing false is found
BASS = [(45, 0.5, 0.5), (48, 1.4, 0.5), (50, 2.3, 0.5), (45, 3.2, 0.5), (43, 4.1, 0.5)]
SCALE = [48, 50, 52, 53, 55, 57, 59, 60, 62, 64, 65, 67, 69, 71, 72, 74, 76, 77, 79, 81, 83, 84]
LEAD = [(pitch, 0.2 + 0.65 * i, 0.5) for i, pitch in enumerate(SCALE)]


def sines(notes, rate):
    """Pure tones with ends that rise and fall in a hundredth of a second."""
    out = np.zeros(int((notes[-1][1] + 1) * rate)) if notes else np.zeros(rate)
    for pitch, start, length in notes:
        t = np.arange(int(length * rate)) / rate
        soft = np.clip(np.minimum(t, length - t) / 0.01, 0, 1)
        at = int(start * rate)
        out[at : at + len(t)] += 0.45 * soft * np.sin(2 * np.pi * 440 * 2 ** ((pitch - 69) / 12) * t)
    return out


def midi(notes, bpm=120.0):
    tick = lambda s: round(s * 480 * bpm / 60)
    events = sorted([(tick(s), 1, p) for p, s, _ in notes] + [(tick(s + d), 0, p) for p, s, d in notes], key=lambda e: e[:2])
    ticks = [0, *(e[0] for e in events)]
    return media.midi_bytes({"line": [(b - a, kind, p, 90 * kind) for a, b, (_, kind, p) in zip(ticks, ticks[1:], events, strict=False)]}, bpm)


def blocks_of(spark, x, size=1 << 15):
    rows = [("a", ch, i, x[a : a + size].tolist()) for ch in range(2) for i, a in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "track string, ch int, block long, v array<double>")


@pytest.mark.parametrize(("name", "notes"), [("bass", BASS), ("lead", LEAD)])
def test_a_line_is_found_whole_and_nothing_else(spark, name, notes):
    """Windows of 8192 and steps of 2048 at 22,050 Hz, starts within 0.15 seconds."""
    reference = spark.createDataFrame([(i, "a", p, s, s + d) for i, (p, s, d) in enumerate(notes)], NOTES)
    scored = analysis.evaluate(blocks_of(spark, sines(notes, 22050)), reference, intervals.preset_of(name), 22050, 8192, 2048, tolerance=0.15).first()
    assert (scored.precision, scored.recall, scored.f1) == (1.0, 1.0, 1.0)


def test_channels_of_blocks(spark):
    x = np.random.default_rng(5).normal(size=(10, 3))
    rows = [("a", ch, b, x[4 * b : 4 * b + 4, ch].tolist()) for ch in range(3) for b in range(3)] + [("one", 0, 0, [1.0, 2.0])]
    held = spark.createDataFrame(rows, "track string, ch int, block long, v array<double>")
    got = {(r.track, r.channel, r.block): r.v for r in blocks.channels(held).collect()}
    assert len(got) == 12
    for b in range(3):
        part = x[4 * b : 4 * b + 4]
        for channel, expected in (("mix", part.mean(axis=1)), ("left", part[:, 0]), ("right", part[:, 1])):
            assert np.allclose(got["a", channel, b], expected)
    assert got["one", "mix", 0] == got["one", "left", 0] == got["one", "right", 0] == [1.0, 2.0]
    assert {r.block: r.v for r in blocks.mono(held.where("track = 'a'")).collect()}[2] == pytest.approx(x[8:].mean(axis=1).tolist())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("set")
    (at / "more").mkdir()
    for name, rate, played, written in [
        ("low", 22050, BASS, BASS),
        ("more/slow", 11025, BASS, BASS[:-1] + [(60, 4.1, 0.5)]),  # one note is written an octave and more too high
        ("silent", 22050, [], BASS[:2]),
    ]:
        (at / f"{name}.wav").write_bytes(media.wav_bytes(np.stack([sines(played, rate)] * 2, axis=1), rate))
        (at / f"{name}.mid").write_bytes(midi(written))
    (at / "low.midi").write_bytes(b"not read, .mid comes first")
    (at / "alone.WAV").write_bytes(media.wav_bytes(sines(BASS, 8000), 8000))
    (at / "without.mid").write_bytes(midi(BASS))
    return at


def test_pairs_are_named_alike(spark, folder):
    got = {r.piece: (r.audio, r.notes) for r in evaluation.pairs(spark, str(folder)).collect()}
    assert got == {str(folder / p): (f"{folder / p}.wav", f"{folder / p}.mid") for p in ("low", "more/slow", "silent")}


def test_a_folder_is_evaluated_by_piece_and_preset(spark, folder):
    scored = evaluation.evaluate_folder(spark, str(folder), "bass", tolerance=0.15)
    held = scored.toPandas()
    got = {(r.piece.removeprefix(f"{folder}/"), r.preset): r for r in held.itertuples()}
    assert set(got) == {("low", "bass"), ("more/slow", "bass"), ("silent", "bass")}
    low, slow, silent = (got[p, "bass"] for p in ("low", "more/slow", "silent"))
    assert (low.precision, low.recall, low.f1, low.n_ref, low.n_est) == (1, 1, 1, 5, 5)
    assert (slow.precision, slow.recall, slow.f1, slow.n_ref, slow.n_est) == (0.8, 0.8, 0.8, 5, 5)
    assert (silent.precision, silent.recall, silent.f1, silent.n_ref, silent.n_est) == (0, 0, 0, 2, 0)
    mean = evaluation.summary(spark.createDataFrame(held)).first()
    assert (mean.preset, mean.files, mean.precision, mean.recall) == ("bass", 3, 0.6, 0.6)


def test_both_presets_have_rows_of_their_own(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(media.wav_bytes(sines(BASS[:2], 11025), 11025))
    (tmp_path / "a.mid").write_bytes(midi(BASS[:2]))
    got = {r.preset: r for r in evaluation.evaluate_folder(spark, str(tmp_path), "both", 4096, tolerance=0.15).collect()}
    assert set(got) == {"bass", "lead"} and got["bass"].n_ref == got["lead"].n_ref == 2 and got["bass"].recall == 1.0


def test_same_scores_as_a_plain_loop(spark):
    """Greedy matching of random notes in many pieces at once, piece by piece in a loop."""
    draw = np.random.default_rng(11)
    rows = [(i, f"p{i % 7}", int(draw.integers(60, 63)), s := round(float(draw.random()), 3), s + 0.4) for i in range(200)]
    ref, est = rows[:100], rows[100:]
    expected = {}
    for piece in {r[1] for r in rows}:
        mine, free = (sorted((r for r in side if r[1] == piece), key=lambda r: (r[3], r[0])) for side in (ref, est))
        n, hit = len(free), 0
        for r in mine:
            fits = [e for e in free if e[2] == r[2] and abs(e[3] - r[3]) <= 0.05 and min(e[4], r[4]) > max(e[3], r[3])]
            if fits:
                free.remove(max(fits, key=lambda e: min(e[4], r[4]) - max(e[3], r[3])))
                hit += 1
        expected[piece] = (round(hit / n, 6), round(hit / len(mine), 6))
    frame = lambda held: spark.createDataFrame(held, NOTES)
    scored = intervals.scores(frame(ref), frame(est), matching.match(frame(ref), frame(est), start=0.05))
    assert sum(p for p, _ in expected.values()) > 2
    assert {r.track: (r.precision, r.recall) for r in scored.collect()} == expected
