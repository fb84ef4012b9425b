"""Decoding of a long track in many tasks: chunks of frames, their min-plus products in order, then paths side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .intervals import Preset, transition_costs
from .lineage import cut
from .transform import rows

#: Costs are whole numbers of this part of one, so sums do not depend on where chunks begin.
UNIT = 1 << 32
#: Dearer than any path through a chunk, and far from the end of 64 bits.
NEVER = 1 << 60
#: Frames of a chunk.
SIZE = 1024


def whole(x) -> np.ndarray:
    return np.rint(np.asarray(x, float) * UNIT).astype(np.int64)


def product(emissions: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The least cost from each state at a chunk's first frame to each at its last, emissions included."""
    total = np.full(cost.shape, NEVER, np.int64)
    np.fill_diagonal(total, emissions[0])
    for e in emissions[1:]:
        total = (total[:, :, None] + cost[None]).min(axis=1) + e
    return total


def before(emissions: np.ndarray, cost: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """For each frame of a chunk but the first, the best state before each state, the lowest of equals."""
    out = np.zeros(emissions.shape, np.int16)
    total, every = enter + emissions[0], np.arange(len(cost))
    for i, e in enumerate(emissions[1:], 1):
        through = total[:, None] + cost
        out[i] = through.argmin(axis=0)
        total = through[out[i], every] + e
    return out


def _table(like: pa.Table, **columns: pa.Array) -> pa.Table:
    """A row of a group: its track and chunk, and these columns."""
    first = like.slice(0, 1)
    return pa.table({"track": first.column("track"), "chunk": first.column("chunk"), **columns})


def _in_order(df: DataFrame, descending: bool, step: Callable, schema: StructType) -> DataFrame:
    """step(what the row before left, row) gives (what is left, new columns), along the chunks of each track; a row a chunk, so few."""
    names = [f.name for f in schema.fields if f.name not in ("track", "chunk")]
    types = {f.name: pa.list_(pa.int64()) if f.dataType.typeName() == "array" else pa.int32() for f in schema.fields if f.name in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, left, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["track"] != track:
                    track, left, begun = row["track"], None, True
                left, found = step(left, row)
                out.append(found)
            columns = [pa.array([o[i] for o in out], types[n]) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column("track"), batch.column("chunk"), *columns], names=["track", "chunk", *names])

    order = F.desc("chunk") if descending else F.asc("chunk")
    return df.repartition("track").sortWithinPartitions("track", order).mapInArrow(run, schema)


def _joined(chunks: DataFrame, found: DataFrame) -> DataFrame:
    named = found.withColumnsRenamed({"track": "_track", "chunk": "_chunk"})
    on = chunks["track"].eqNullSafe(named["_track"]) & (chunks["chunk"] == named["_chunk"])
    return chunks.join(named, on).drop("_track", "_chunk")


def decode_chunks(salient: DataFrame, hop: float, preset: Preset, size: int = SIZE) -> DataFrame:
    """(track, frame, state): the path of ``intervals.decode``, with the frames of one track in many tasks.

    salient: (track, frame, s), a row a frame; frames may be missing.  Each chunk gives the min-plus
    product of its frames; these, one matrix a chunk, are passed along a track for the costs at which
    a chunk is entered.  Then chunks find their best states before each state side by side, and say
    from which first state each last state comes; passed along backwards, that fixes the state at
    every chunk's end, and chunks trace their paths side by side.  The lowest state of equals is
    taken at each step back, as there.  A task holds one chunk; costs are whole numbers of UNIT.  No
    frames give no rows.
    """
    if size < 1:
        raise ValueError("a chunk has one frame at least")
    n = preset.high - preset.low + 1
    cost, rest = whole(transition_costs(n, hop, preset)), whole(preset.rest_emission)
    key = salient.select("track", F.lit(0).cast("long").alias("chunk")).schema

    def fields(*added: tuple[str, str]) -> StructType:
        out = StructType(list(key.fields))
        for name, kind in added:
            out = out.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)
        return out

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame")
        s = np.stack(rows(group.column("s")))
        e = np.concatenate([whole(1.0 - s), np.full((len(s), 1), rest)], axis=1)
        return _table(
            group,
            frames=pa.array([group.column("frame").to_pylist()], pa.list_(pa.int64())),
            emissions=pa.array([e.astype("<i8").tobytes()], pa.binary()),
            product=pa.array([product(e, cost).ravel().tolist()], pa.list_(pa.int64())),
        )

    held = salient.select("track", F.col("frame").cast("long").alias("frame"), "s").withColumn("chunk", F.floor(F.col("frame") / size))
    packed = held.groupBy("track", "chunk").applyInArrow(pack, fields(("frames", "array<bigint>"), ("emissions", "binary"), ("product", "array<bigint>")))
    packed = cut(packed)

    def forwards(left: np.ndarray | None, row: dict):
        """The costs at which a chunk's first states are entered, less the least of them, and from where; the best state at its end."""
        if left is None:
            enter, came = np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        else:
            through = left[:, None] + cost
            came = through.argmin(axis=0)
            enter = through[came, np.arange(n + 1)]
            enter -= enter.min()
        total = (enter[:, None] + np.array(row["product"], np.int64).reshape(n + 1, n + 1)).min(axis=0)
        return total, (enter.tolist(), came.tolist(), int(total.argmin()))

    entered = _in_order(packed.select("track", "chunk", "product"), False, forwards, fields(("enter", "array<bigint>"), ("came", "array<bigint>"), ("best", "int")))

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, firsts = [], []
            for emissions, enter in zip(batch.column("emissions").to_pylist(), batch.column("enter").to_pylist(), strict=True):
                back = before(np.frombuffer(emissions, "<i8").reshape(-1, n + 1), cost, np.array(enter, np.int64))
                state = np.arange(n + 1)
                for step in back[:0:-1]:
                    state = step[state]
                steps.append(back.astype("<i2").tobytes())
                firsts.append(state.tolist())
            kept = [batch.column(c) for c in ("track", "chunk", "frames", "came", "best")]
            made = [pa.array(steps, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(kept + made, names=["track", "chunk", "frames", "came", "best", "back", "firsts"])

    columns = fields(("frames", "array<bigint>"), ("came", "array<bigint>"), ("best", "int"), ("back", "binary"), ("firsts", "array<bigint>"))
    looked = cut(_joined(packed.drop("product"), entered).mapInArrow(look_back, columns))

    def backwards(left: int | None, row: dict):
        """The state at a chunk's end, known from the chunk after it, and the one before the chunk begins."""
        end = row["best"] if left is None else left
        return row["came"][row["firsts"][end]], (end,)

    ends = _in_order(looked.select("track", "chunk", "came", "best", "firsts"), True, backwards, fields(("end", "int")))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (steps, end) in enumerate(zip(batch.column("back").to_pylist(), batch.column("end").to_pylist(), strict=True)):
                back = np.frombuffer(steps, "<i2").reshape(-1, n + 1)
                states = np.empty(len(back), np.int32)
                states[-1] = end
                for f in range(len(back) - 1, 0, -1):
                    states[f - 1] = back[f][states[f]]
                frames = batch.column("frames").slice(i, 1).flatten()
                track = batch.column("track").take(pa.array([i] * len(frames), pa.int64()))
                yield pa.RecordBatch.from_arrays([track, frames, pa.array(states, pa.int32())], names=["track", "frame", "state"])

    schema = held.select("track", "frame").schema.add("state", "integer")
    return _joined(looked.select("track", "chunk", "frames", "back"), ends).mapInArrow(trace, schema)
