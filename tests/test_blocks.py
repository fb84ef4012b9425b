"""Signals as blocks against plain arrays, and the source that reads ranges of files."""

import hashlib
import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.operators import blocks as B
from resona.operators import rhythm, separation, transform
from resona.sources import media, ranges

SIZE = 64


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {"a": rng.normal(size=1000), "b": rng.normal(size=SIZE), "c": rng.normal(size=SIZE + 1), "d": rng.normal(size=3), "e": rng.normal(size=640)}


@pytest.fixture(scope="module")
def table(spark, signals):
    return spark.createDataFrame([(k, n, float(x)) for k, v in signals.items() for n, x in enumerate(v)], "track string, n long, v double").repartition(5).cache()


@pytest.fixture(scope="module")
def held(table):
    return B.to_blocks(table, SIZE).cache()


def arrays(blocks, size=SIZE, by=("track",)):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: r["block"]):
        key = r[by[0]] if len(by) == 1 else tuple(r[c] for c in by)
        assert len(out.setdefault(key, [])) == r["block"] * size
        out[key] += r["v"]
    return {k: np.array(v) for k, v in out.items()}


def test_blocks_and_back(held, table, signals):
    assert all(np.array_equal(v, signals[k]) for k, v in arrays(held).items())
    assert sorted(map(tuple, B.samples(held, SIZE).collect())) == sorted(map(tuple, table.collect()))
    assert {r["track"]: r["samples"] for r in B.lengths(held, SIZE).collect()} == {k: len(v) for k, v in signals.items()}


def test_halos(held, signals):
    for r in B.with_halo(held, 10, 20, SIZE).collect():
        v, a = signals[r["track"]], r["block"] * SIZE
        assert r["head"] == v[max(0, a - 10) : a].tolist() and r["tail"] == v[a + SIZE : a + SIZE + 20].tolist()
        assert r["v"] == v[a : a + SIZE].tolist() and r["last"] == (a + SIZE >= len(v))
    with pytest.raises(ValueError):
        B.with_halo(held, SIZE + 1, 0, SIZE)


@pytest.mark.parametrize("win,hop", [(16, 4), (64, 16), (30, 7), (64, 63), (8, 1)])
def test_transforms_equal_those_of_rows(held, table, win, hop):
    key = lambda r: (r["track"], r["frame"])
    got, want = (sorted(x.collect(), key=key) for x in (B.stft(held, win, hop, SIZE), transform.stft(table, win, hop)))
    assert [key(r) for r in got] == [key(r) for r in want]
    assert all(np.allclose(a["re"], b["re"], atol=1e-12) and np.allclose(a["im"], b["im"], atol=1e-12) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("win,hop", [(64, 16), (30, 7)])
def test_round_trip(held, signals, win, hop):
    back = arrays(B.istft(B.stft(held, win, hop, SIZE), B.lengths(held, SIZE), win, hop, SIZE))
    assert back.keys() == signals.keys() and all(np.allclose(back[k], v, atol=1e-9) for k, v in signals.items())


def test_no_step_has_a_row_for_each_sample(spark, tmp_path):
    """What the exchanges of a transform and its inverse carry: a few rows for each block and frame."""
    n, size, win, hop = 200_000, 8192, 2048, 512
    rows = [("t", b, np.arange(b * size, min((b + 1) * size, n)).astype(float).tolist()) for b in range(-(-n // size))]
    spark.createDataFrame(rows, "track string, block long, v array<double>").write.parquet(f"{tmp_path}/blocks")
    held = spark.read.parquet(f"{tmp_path}/blocks")
    back = B.istft(B.stft(held, win, hop, size), B.lengths(held, size), win, hop, size)
    assert back.agg(F.sum(F.size("v"))).first()[0] == n
    carried = 0
    plan = back._jdf.queryExecution().executedPlan()
    back.collect()

    def walk(node):
        nonlocal carried
        for name in ("finalPhysicalPlan", "plan"):
            try:
                walk(getattr(node, name)())
            except Exception:  # noqa: BLE001, S110  # not a node of this kind
                pass
        if node.nodeName() == "Exchange":
            written = node.metrics().get("shuffleRecordsWritten")
            carried += written.get().value() if written.isDefined() else 0
        children = node.children()
        for i in range(children.length()):
            walk(children.apply(i))

    walk(plan)
    assert 0 < carried < 4 * (3 * len(rows) + n // hop)


def test_chunks_blend_to_the_signal(held, signals):
    plan = separation.chunks(B.lengths(held, SIZE).withColumnRenamed("samples", "total"), separation.pulled_back(F.col("total"), 100, 50))

    def work(x, row):
        assert np.array_equal(x, signals[row["track"]][row["start"] : row["end"]])
        return {"y": transform.lists(x[None, :])}

    parts = B.chunked(held, plan, work, [T.StructField("y", T.ArrayType(T.DoubleType()))], SIZE)
    back = arrays(B.blended(parts, SIZE))
    assert back.keys() == signals.keys() and all(np.allclose(back[k], v) for k, v in signals.items())


def plain_resampled(x, up, down):
    """The signal with zeros between, through the filter, and every down-th of that."""
    common = np.gcd(up, down)
    up, down = up // common, down // common
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    taps = B.low_pass(up, down)
    half = len(taps) // 2
    return np.convolve(wide, taps)[half : half + len(wide)][::down][: -(-len(x) * up // down)]


@pytest.mark.parametrize("up,down", [(3, 2), (2, 3), (1, 2), (5, 1), (6, 4), (160, 147), (7, 5)])
def test_polyphase_equals_convolution(held, signals, up, down):
    back = arrays(B.resampled(held, up, down, SIZE))
    for k, v in signals.items():
        want = plain_resampled(v, up, down)
        assert back[k].shape == want.shape and np.allclose(back[k], want, atol=1e-12)
    assert B.resampled(held, 4, 4, SIZE) is held


def test_a_tone_keeps_its_pitch_and_height(spark):
    tone = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)
    held = spark.createDataFrame([("t", b, tone[b * 4096 : (b + 1) * 4096].tolist()) for b in range(11)], "track string, block long, v array<double>")
    back = arrays(B.resampled(held, 16000, 44100, 4096), 4096)["t"]
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert len(back) == 16000 and np.abs(back - want)[200:-200].max() < 2e-3


def test_rolled_and_cut(spark, held, signals):
    shifts = spark.createDataFrame([(k, len(v), 37 * len(k) * (len(v) // 3 + 1)) for k, v in signals.items()], "track string, samples long, by long")
    moved = B.rolled(held, shifts, SIZE)
    assert all(np.array_equal(x, np.roll(signals[k], 37 * (len(signals[k]) // 3 + 1))) for k, x in arrays(moved).items())
    back = B.rolled(moved, shifts.withColumn("by", -F.col("by")), SIZE)
    assert all(np.array_equal(x, signals[k]) for k, x in arrays(back).items())
    assert all(np.allclose(x, signals[k]) for k, x in arrays(B.mean(held.union(back), SIZE)).items())
    shorter = B.cut_to(held, shifts.select("track", (F.col("samples") - 2).alias("samples")), SIZE)
    assert all(np.array_equal(x, signals[k][:-2]) for k, x in arrays(shorter).items())


@pytest.mark.parametrize("rate,model_rate,passes", [(100, 100, 1), (100, 100, 3), (100, 150, 2)])
def test_separation_by_a_model(held, signals, rate, model_rate, passes):
    """All of the way: a model that halves its chunk gives two stems that add up to what the changes of rate leave."""
    parts = separation.separate_by_model(held, rate, model_rate, 100, 50, lambda x: [x / 4, 3 * x / 4], ("low", "high"), passes, SIZE)
    got = arrays(parts, by=("track", "stem"))
    for k, v in signals.items():
        want = v if rate == model_rate else plain_resampled(plain_resampled(v, model_rate, rate), rate, model_rate)[: len(v)]
        # blended chunks are the signal itself, so only where blocks of the inner rate end do the two differ in rounding
        assert np.allclose(got[k, "low"], want / 4, atol=1e-9) and np.allclose(got[k, "high"], 3 * want / 4, atol=1e-9)


def test_correlation_equals_sums_of_products(held, table, signals):
    got = {(r["track"], r["lag"]): r["ac"] for r in B.correlated(held, 40, SIZE).collect()}
    want = {}
    for k, v in signals.items():
        x = v - v.mean()
        sums = [float(x[lag:] @ x[: len(x) - lag]) for lag in range(min(40, len(x)))]
        want |= {(k, lag): s / max(sums) for lag, s in enumerate(sums)}
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-12 for k, x in want.items())
    long = {(r["track"], r["lag"]): r["ac"] for r in rhythm.autocorrelation(table.withColumnRenamed("n", "t").withColumnRenamed("v", "x"), 40).collect()}
    assert long.keys() == want.keys() and all(abs(long[k] - x) < 1e-12 for k, x in want.items())


def test_extremes_of_spans(spark, held, signals):
    rng, spans = np.random.default_rng(1), []
    for k, v in signals.items():
        for i in range(60):
            a = int(rng.integers(0, len(v)))
            spans.append((k, i, a, int(rng.integers(a + 1, len(v) + 1))))
        spans += [(k, 60, 0, len(v)), (k, 61, len(v) - 1, len(v))]
    asked = spark.createDataFrame(spans, "track string, id int, a long, b long")
    for cell, fan in ((4, 4), (8, 2), (64, 16)):
        levels = B.pyramid(held, SIZE, cell=cell, fan=fan)
        got = {(r["track"], r["id"]): (r["low"], r["high"]) for r in B.extremes(held, levels, asked, SIZE, cell=cell, fan=fan).collect()}
        assert got == {(k, i): (signals[k][a:b].min(), signals[k][a:b].max()) for k, i, a, b in spans}


# ranges of files


def wav(path, values, rate=100, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(values.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        whole = np.round(values * (1 << (8 * width - 1))).astype(np.int64)
        f.writeframes(b"".join(int(x).to_bytes(width, "little", signed=True) for x in whole.reshape(-1)))


def test_files_as_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    held = {n: np.round(rng.uniform(-0.9, 0.9, (n, ch)) * 64) / 128 for n, ch in ((1000, 2), (64, 1), (1, 3))}
    for n, v in held.items():
        wav(tmp_path / f"{n}.wav", v, width=3 if n == 64 else 2)
    got = ranges.read_wav_blocks(spark, str(tmp_path), size=64, stretch=3)
    for n, v in held.items():
        own = arrays(got.where(F.col("track").endswith(f"/{n}.wav")).select("ch", "block", "v"), 64, ("ch",))
        assert {c: x.tolist() for c, x in own.items()} == {c: v[:, c].tolist() for c in range(v.shape[1])}
    rows = media.read_wav(spark, str(tmp_path / "1000.wav"), 2.0, 5.0).where("ch = 1").orderBy("n").collect()
    sliced = ranges.read_wav_blocks(spark, str(tmp_path / "1000.wav"), 2.0, 5.0, size=64)
    assert arrays(sliced.where("ch = 1"), 64)[str(tmp_path / "1000.wav")].tolist() == [r["v"] for r in rows]
    assert {r["block"] for r in sliced.where("block >= 2 and block < 4").collect()} == {2, 3}
    with pytest.raises(Exception, match="begins after the end"):
        ranges.read_wav_blocks(spark, str(tmp_path / "64.wav"), 9.0).collect()


def test_a_slice_of_a_large_file_reads_its_own_bytes(spark, tmp_path):
    """A file beyond what the other reader takes, with holes for what is not there."""
    rate, frames = 44_100, (media.LARGEST // 4) + 10_000_000
    mark = np.arange(1, 2 * rate + 1, dtype="<i2").reshape(-1, 2)
    at = 3000 * rate
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + 4 * frames) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, 4 * rate, 4, 16) + b"data" + struct.pack("<I", 4 * frames))
        f.seek(44 + 4 * at)
        f.write(mark.tobytes())
        f.truncate(44 + 4 * frames)
    path = str(tmp_path / "long.wav")
    reader = ranges.WavReader({"path": path, "start": "3000", "end": "3001", "size": "4096", "stretch": "2"})
    reads = [p.bytes(4096) for p in reader.partitions()]
    assert sum(b - a for a, b in reads) == 4 * rate and len(reads) == 6 and all(a < b for a, b in reads)
    got = arrays(ranges.read_wav_blocks(spark, path, 3000, 3001, size=4096, stretch=2).where("ch = 0"), 4096)[path]
    assert np.array_equal(got * 32768, mark[:, 0])
    reader.low, reader.high = 3, 5  # as a filter on the block leaves them
    assert sum(b - a for a, b in (p.bytes(4096) for p in reader.partitions())) == 2 * 4096 * 4
    whole = ranges.WavReader({"path": path})
    assert sum(b - a for a, b in (p.bytes(whole.size) for p in whole.partitions())) == 4 * frames
    with pytest.raises(media.TooLarge):
        media.read_wav(spark, path, 3000, 3001)


def test_filters_on_the_block_are_taken():
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = ranges.WavReader({"path": "x"})
    left = list(reader.pushFilters([GreaterThan(("block",), 4), LessThanOrEqual(("block",), 9), EqualTo(("ch",), 1)]))
    assert (reader.low, reader.high) == (5, 10) and left == [EqualTo(("ch",), 1)]


@pytest.mark.parametrize("data", [b"", b"RIFF\0\0\0\0WAVE", b"MThd" + bytes(60), b"RIFF\0\0\0\0WAVEdata" + bytes(8), b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 85, 2, 1, 4, 4, 16) + b"data" + bytes(4)])
def test_other_files_are_refused(data):
    with pytest.raises(media.UnsupportedFormat):
        ranges.layout(io.BytesIO(data), len(data))


def test_chunks_before_the_samples_are_passed_over():
    extra = b"LIST" + struct.pack("<I", 70_001) + bytes(70_002)
    head = b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack("<I", 8)
    data = head + np.array([0.25, -0.5], "<f4").tobytes()
    form = ranges.layout(io.BytesIO(data), len(data))
    assert (form.rate, form.frames, form.at) == (8000, 2, len(head))
    assert ranges.decoded(data[form.at :], form).tolist() == [[0.25], [-0.5]]


def test_sinks_of_blocks_equal_those_of_whole_signals(spark):
    """Parts put together in order are the file that the writer of the standard library gives; hashes go on over blocks."""
    x = {t: np.random.default_rng(n).normal(0, 0.7, n) for t, n in (("a", 100), ("b", 64), ("c", 1))}
    rows = [(t, i, v[a : a + 32].tolist()) for t, v in x.items() for i, a in enumerate(range(0, len(v), 32))]
    held = spark.createDataFrame(rows, "track string, block long, v array<double>").repartition(3)
    files = {r.track: bytes(r.content) for r in B.wav_files(held, 8000, 32).collect()}
    assert files == {t: media.wav_bytes(v, 8000) for t, v in x.items()}
    parts = B.wav_parts(held, 8000, 32).where("track = 'a'").orderBy("block").collect()
    assert [r.block for r in parts] == [-1, 0, 1, 2, 3] and [len(r.content) for r in parts] == [44, 64, 64, 64, 8]
    prints = {r.track: r.pcm16 for r in B.fingerprints(held).collect()}
    assert prints == {t: hashlib.sha256(media.pcm16(v)).hexdigest()[:16] for t, v in x.items()}
    assert B.fingerprints(held.limit(0)).count() == 0


def test_chunks_and_blocks_are_rows_and_not_groups(spark):
    """A call of Python for each group of a chunk's or block's samples took longer than all of its work."""
    held = B.to_blocks(spark.createDataFrame([("a", i, float(i % 7)) for i in range(700)], "track string, n long, v double"), SIZE)
    found = separation.separate_by_model(held, 2, 3, 100, 50, lambda x: [x / 4, 3 * x / 4], ("low", "high"), 2, SIZE)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_results_of_a_batch_go_out_in_several(monkeypatch):
    """Each with the keys of the rows that made them; rows that make nothing are left out."""
    monkeypatch.setattr(B, "FULL", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(40)])], names=["track"])
    made = ([pa.array([i] * (i % 3), pa.int64())] for i in range(40))
    out = list(B._gathered(batch, ("track",), ["track", "x"], made))
    assert len(out) > 1
    assert [(r["track"], r["x"]) for b in out for r in b.to_pylist()] == [(f"t{i}", i) for i in range(40) for _ in range(i % 3)]
