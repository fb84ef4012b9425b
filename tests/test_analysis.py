"""Excerpts of recordings, and the stages of an analysis."""

import json

import numpy as np
import pandas as pd
import pytest

from resona.operators import analysis, spectral

RATE = 8000


def clicks(spark, seconds, first=0):
    """Clicks at 120 beats a minute in both channels, the left louder; samples are numbered from first."""
    x = np.zeros(seconds * RATE)
    burst = np.sin(2 * np.pi * 1000 * np.arange(400) / RATE) * np.exp(-np.arange(400) / 80)
    for k in range(2 * seconds):
        x[k * 4000 : k * 4000 + 400] += burst
    held = [pd.DataFrame({"track": "a", "ch": ch, "n": np.arange(len(x)) + first, "v": x * gain}) for ch, gain in ((0, 1.0), (1, 0.25))]
    return spark.createDataFrame(pd.concat(held))


def payload(df):
    return json.loads(df.first().payload)


def test_an_excerpt_is_analysed_as_if_it_were_all(spark):
    whole = payload(analysis.analyse(clicks(spark, 6), RATE, 512, columns=90))
    cut = payload(analysis.analyse(clicks(spark, 10), RATE, 512, columns=90, start=2.0, end=8.0))
    assert (whole["offsetSec"], whole["endSec"], cut["offsetSec"], cut["endSec"]) == (0.0, None, 2.0, 8.0)
    assert cut["durationSec"] == 6.0 and cut["initViewSec"] == 6.0
    same = set(whole) - {"offsetSec", "endSec"}
    assert {k: whole[k] for k in same} == {k: cut[k] for k in same}


def test_bounds_of_excerpts(spark):
    held = spark.createDataFrame([("a", i) for i in range(20)], "track string, n long")
    numbers = lambda *bounds: sorted(r.n for r in analysis.excerpt(held, 10, *bounds).collect())
    assert numbers() == list(range(20)) and numbers(0.5) == list(range(15)) and numbers(0.5, 1.0) == list(range(5)) and numbers(5.0) == []
    assert numbers(1.0, 99.0) == list(range(10))
    for bad in [(-1.0,), (1.0, 1.0), (2.0, 1.0)]:
        with pytest.raises(ValueError, match="excerpt"):
            analysis.excerpt(held, 10, *bad)


def test_stages_are_counted_in_order(spark):
    stages = analysis.Stages()
    out = analysis.analyse(clicks(spark, 6), RATE, 512, columns=90, stages=stages)
    assert stages.names == ["decode", "stft", "aggregate", "payload"]
    got = payload(out)
    rows = stages.rows()
    assert list(rows) == stages.names
    assert rows["decode"] == 2 * 6 * RATE and rows["payload"] == 1
    assert rows["aggregate"] == 3 * 88 * got["nCols"]
    assert rows["stft"] % 3 == 0 and rows["stft"] // 3 >= 6 * RATE // 512


def test_levels_near_a_half_are_rounded_as_the_sql_rounds_them(spark, duck):
    """A level within a millionth of a half is that half, and goes to the even step; without the digits it went to the nearer one."""
    levels = [126.5000002, 127.4999998, 200.5000003, 63.4999997, 100.500002, 101.499998]
    m = [1.0] + [10 ** ((x / 255 * 70 - 70) / 20) for x in levels] + [1e-9, 1e-9]
    frames = spark.createDataFrame([(("a", "mix"), 0, m)], "track struct<track string, channel string>, frame long, m array<double>")
    got = {r.row: r.q for r in analysis.channel_cells(frames, RATE, 16, 10).collect()}
    sql = "round_even(round(least(greatest((greatest(10 * log10(greatest(p, 1e-12)), -70.0) + 70.0) / 70.0, 0.0), 1.0) * 255, 6), 0)::int"
    for row, at, n in spectral.bands(9, 16, RATE):
        assert n == 1 and got[row] == duck.sql(f"select {sql} from (select {m[at] * m[at]!r}::double as p)").fetchall()[0][0]
    reached = {at for _, at, _ in spectral.bands(9, 16, RATE)}
    assert {1, 2, 3, 4} <= reached and {got[r] for r, at, _ in spectral.bands(9, 16, RATE) if at in (1, 2, 3, 4)} == {126, 128, 200, 64}


def test_cells_are_pooled_without_a_key_for_each(spark):
    """No row for each cell goes through a shuffle, and rows of one range of bins are pooled as one."""
    ranges, places = spectral.kinds(RATE, 16)
    assert len(ranges) == 9 and [ranges[k] for k in places] == [(a, n) for _, a, n in spectral.bands(9, 16, RATE)]
    held = analysis.channel_columns(analysis.channel_spectra(clicks(spark, 1), 16), RATE, 16, 10)
    assert held.groupBy("channel").count().where("count > 10").count() == 0
    plan = analysis.analyse(clicks(spark, 1), RATE, 16, columns=10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


@pytest.mark.parametrize("sub", [1, 5])
def test_columns_are_the_maxima_of_rows(spark, sub):
    """Pooled columns against the pool that has a row for each cell."""
    held = [(("a", c), i, [float((i * j + k) % 7) for j in range(33)]) for k, c in enumerate(("mix", "left")) for i in range(12)]
    spectra = spark.createDataFrame(held, "track struct<track string, channel string>, frame long, m array<double>")
    power = spectral.band_power(spectra, RATE, 64, sub)
    if sub > 1:
        power = power.withColumn("p", spectral.widen(power["p"], 88 * sub, sub))
    plain = spectral.pool(power, 7).select("track.track", "track.channel", "row", "col", "p")
    key = lambda df: sorted((r.channel, r.row, r.col, r.q) for r in df.collect())
    assert key(analysis.channel_cells(spectra, RATE, 64, 7, sub)) == key(spectral.quantised(plain, digits=analysis.DIGITS))
