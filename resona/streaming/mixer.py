"""A mixer's mute and solo buttons as a state machine over a stream of presses.

Solo is no overlay: it is written into the mutes of all strips, and what they were is kept, so that its
release gives them back.  A strip is never both muted and solo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store of states that keeps maps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "session string, seq bigint, strip string, muted boolean, solo boolean"


def release(strips: dict, kept: dict, strip: str) -> None:
    """The solo of a strip ends: all mutes are as they were before it, but the strip itself stays audible."""
    for name, state in strips.items():
        state["solo"] = False
        state["muted"] = name != strip and kept.get(name, False)
    kept.clear()


def press(strips: dict, kept: dict, strip: str, button: str) -> None:
    """One press of ``solo`` or ``mute``; strips: {name: {muted, solo}}, kept: the mutes before a solo. ``add`` makes a strip."""
    alone = next((name for name, s in strips.items() if s["solo"]), None)
    if button == "add":
        # a strip that comes during a solo is silent, and audible after it
        strips.setdefault(strip, {"muted": alone is not None, "solo": False})
        return
    if strip not in strips or button not in ("solo", "mute"):
        raise ValueError(f"no strip {strip!r} with a button {button!r}")
    own = strips[strip]
    if button == "solo" and own["solo"]:
        release(strips, kept, strip)
    elif button == "solo":
        own["muted"] = False
        if alone is None:  # a solo that moves keeps the mutes from before the first
            kept.update({name: s["muted"] for name, s in strips.items()})
        for name, s in strips.items():
            s["solo"], s["muted"] = name == strip, name != strip
    elif own["muted"]:
        if alone is not None:
            release(strips, kept, alone)
        own["muted"] = False
    else:
        if own["solo"]:
            release(strips, kept, strip)
        own["muted"] = True


class Mixer(StatefulProcessor):
    """Keeps the strips of a session and the mutes before its solo as maps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.strips = handle.getMapState("strips", "strip string", "muted boolean, solo boolean")
        self.kept = handle.getMapState("kept", "strip string", "muted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        strips = {k[0]: {"muted": v[0], "solo": v[1]} for k, v in self.strips.iterator()}
        kept = {k[0]: v[0] for k, v in self.kept.iterator()}
        out = []
        for event in pd.concat(list(rows)).sort_values("seq").itertuples():
            press(strips, kept, event.strip, event.button)
            out += [(key[0], event.seq, name, s["muted"], s["solo"]) for name, s in sorted(strips.items())]
        for name, s in strips.items():
            self.strips.updateValue((name,), (s["muted"], s["solo"]))
        self.kept.clear()
        for name, muted in kept.items():
            self.kept.updateValue((name,), (muted,))
        yield pd.DataFrame(out, columns=["session", "seq", "strip", "muted", "solo"])

    def close(self) -> None:
        pass


def mixer(spark: SparkSession, presses: DataFrame) -> DataFrame:
    """(session, seq, strip, muted, solo): all strips of a session after each press of a stream (session, seq, strip, button)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return presses.groupBy("session").transformWithStateInPandas(statefulProcessor=Mixer(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
