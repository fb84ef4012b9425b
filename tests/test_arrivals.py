"""Files that arrive, and the mixer's state machine, each with a restart from its checkpoint."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.sources import media
from resona.streaming import ingest, mixer


def test_files_are_judged_and_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = media.wav_bytes(np.zeros(100), 8000)
    (folder / "a b.wav").write_bytes(good)
    (folder / "empty.wav").write_bytes(media.wav_bytes(np.zeros(0), 8000))
    (folder / "short.wav").write_bytes(good[:-10])
    (folder / "long.wav").write_bytes(media.wav_bytes(np.zeros(5000), 8000))
    (folder / "text.wav").write_bytes(b"no sound at all, but some bytes")
    handed = []

    def handle(files):
        handed.append(files.count())
        return files.select("name", F.sha2("content", 256).alias("sha256"))

    def run():
        query = ingest.ingest(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "checkpoint"), handle, largest=5000)
        query.awaitTermination(60)
        assert query.exception() is None
        read = lambda name: sorted(map(tuple, spark.read.parquet(str(tmp_path / "store" / name)).drop("path", "sha256").collect()))
        return read("accepted"), read("rejected")

    first = [("a b.wav", 0)], [("empty.wav", 44, "empty", 0), ("long.wav", 10044, "too large", 0), ("short.wav", 234, "short", 0), ("text.wav", 31, "unsupported", 0)]
    assert run() == first
    assert run() == first and sum(handed) == 1  # nothing comes twice after a restart
    (folder / "later.wav").write_bytes(good)
    (folder / "later empty.wav").write_bytes(media.wav_bytes(np.zeros(0), 8000))
    accepted, rejected = run()
    assert accepted == [("a b.wav", 0), ("later.wav", 1)] and sum(handed) == 2
    assert sorted(rejected) == sorted([*first[1], ("later empty.wav", 44, "empty", 1)])


def strips(**muted):
    return {k: {"muted": v, "solo": False} for k, v in muted.items()}


def test_transitions():
    held, kept = strips(mix=False, a=False, b=True), {}

    def now():
        return {k: "S" if s["solo"] else "m" if s["muted"] else "-" for k, s in held.items()}

    mixer.press(held, kept, "a", "solo")
    assert now() == {"mix": "m", "a": "S", "b": "m"}
    mixer.press(held, kept, "b", "solo")  # the solo moves, from a muted strip
    assert now() == {"mix": "m", "a": "m", "b": "S"}
    mixer.press(held, kept, "b", "solo")  # released: the mutes from before, but b stays audible
    assert now() == {"mix": "-", "a": "-", "b": "-"} and not kept
    mixer.press(held, kept, "b", "mute")
    mixer.press(held, kept, "a", "solo")
    mixer.press(held, kept, "mix", "mute")  # unmuting another releases the solo first
    assert now() == {"mix": "-", "a": "-", "b": "m"}
    mixer.press(held, kept, "a", "solo")
    mixer.press(held, kept, "a", "mute")  # muting the soloist releases it first
    assert now() == {"mix": "-", "a": "m", "b": "m"}
    mixer.press(held, kept, "a", "solo")  # a muted strip that is soloed is no longer muted before
    mixer.press(held, kept, "a", "solo")
    assert now() == {"mix": "-", "a": "-", "b": "m"}
    with pytest.raises(ValueError):
        mixer.press(held, kept, "none", "solo")


def test_never_muted_and_solo():
    rng = random.Random(0)
    held, kept = strips(mix=False, a=False, b=False, c=False), {}
    for _ in range(3000):
        mixer.press(held, kept, rng.choice("abc"), rng.choice(["solo", "mute"]))
        assert not any(s["muted"] and s["solo"] for s in held.values())
        solo = [k for k, s in held.items() if s["solo"]]
        assert len(solo) <= 1 and bool(kept) == bool(solo)
        assert not solo or all(s["muted"] for k, s in held.items() if k != solo[0])


def test_a_stream_of_presses_and_a_restart(spark, tmp_path):
    """Two sessions, whose presses come in three files, the last two after a restart."""
    rng = random.Random(1)
    events = {s: [(s, i, strip, "add") for i, strip in enumerate(("a", "b", "mix"))] for s in ("x", "y")}
    for s, rows in events.items():
        rows += [(s, i, rng.choice(["a", "b", "mix"]), rng.choice(["solo", "mute"])) for i in range(3, 40)]
    want = set()
    for s, rows in events.items():
        held, kept = {}, {}
        for _, seq, strip, button in rows:
            mixer.press(held, kept, strip, button)
            want |= {(s, seq, k, v["muted"], v["solo"]) for k, v in held.items()}
    schema = "session string, seq bigint, strip string, button string"

    def run():
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = mixer.mixer(spark, arriving).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for a, b in ((0, 10), (10, 25), (25, 40)):
            rows = [r for held in events.values() for r in held[a:b]]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if a != 10:
                run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {tuple(r) for r in spark.read.schema(mixer.OUTPUT).parquet(str(tmp_path / "out")).collect()} == want
