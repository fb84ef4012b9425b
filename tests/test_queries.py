"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from resona import plans

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    if hasattr(x, "item"):
        x = x.item()
    return float(x) if isinstance(x, int | float) else x


def rows(frame, names):
    return sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, DATA).toPandas(), duck.sql(plans.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    assert rows(ours, names) == rows(theirs, names)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_note_conf_scores_every_decoded_segment(spark):
    decoded = plans.QUERIES["viterbi_states"](spark, DATA).toPandas().sort_values(["track", "frame"])
    salient = {(r.track, r.frame, r.pitch): r.s for r in plans.QUERIES["salience_norm"](spark, DATA).collect()}
    rest, low, expected = 37, 48, []
    for track, part in decoded.groupby("track"):
        segments, at = [], 0
        states, first = part["state"].tolist(), part["frame"].iloc[0]
        for i in range(1, len(states) + 1):
            if i == len(states) or states[i] != states[at]:
                if states[at] != rest:
                    if segments and segments[-1][0] == states[at] and (at - segments[-1][2]) * 0.01 <= 0.06 + 1e-9:
                        segments[-1][2] = i
                    else:
                        segments.append([states[at], at, i])
                at = i
        for state, a, b in segments:
            held = [salient[track, first + f, low + state] for f in range(a, b)]
            expected.append((track, state, first + a, first + b, sum(held) / len(held)))
    got = sorted(tuple(r) for r in plans.QUERIES["note_conf_segments"](spark, DATA).select("track", "state", "f0", "f1", "conf").collect())
    expected.sort()
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert all(abs(g[4] - e[4]) < 1e-4 for g, e in zip(got, expected))
    assert len({r[1] for r in got}) > 0 and max(r[3] for r in got) > 28


def test_ewma_speed_has_every_event(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_type", "ts", "event_id").select("event_type", "value").collect()
    expected, speed, k = {}, {}, {}
    for kind, value in events:
        speed[kind] = 0.7 * speed[kind] + 0.3 * value if kind in speed else value
        k[kind] = k.get(kind, 0) + 1
        expected[kind, k[kind]] = speed[kind]
    got = {(r.event_type, r.k): r.speed for r in plans.QUERIES["ewma_speed_all"](spark, DATA).collect()}
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-6 for x in got)


@pytest.mark.parametrize(("name", "n"), [("widen_rows_all", 440), ("widen_rows", 440), ("intensity_all", 88), ("intensity", 88)])
def test_every_row_is_there(spark, name, n):
    assert [r[0] for r in plans.QUERIES[name](spark, DATA).select("row").distinct().orderBy("row").collect()] == list(range(n))


def test_entry(spark):
    held = entry.entry(spark)
    assert held.columns == ["track", "row", "col", "q"] and held.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
