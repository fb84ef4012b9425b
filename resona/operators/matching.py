"""Greedy one-to-one matching of notes, by spans of time that are worked out side by side.

Each reference note, in order of start, takes the free estimate that it overlaps most.  So what a note
gets depends on all before it; but a span of time, wider than twice the tolerance, touches only the
estimates that the span before it may have taken.  Every span is first worked out as if nothing before
it were taken.  Then each learns which estimates on its border the span before took, and those for which
that is new are worked out again, until none is: the first span is right at once, and each is right one
round after the one before it, mostly at once.  A group is a span's notes, never a track's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import cut

#: Width of a span in tolerances, and the least in seconds.
TOLERANCES, LEAST = 8, 1.0


def _take(ref: dict, est: dict, taken: np.ndarray, pitch: float, start: float) -> np.ndarray:
    """For each reference note the place of the estimate it takes, or -1; taken: the estimates that are gone."""
    free = ~taken
    out = np.full(len(ref["start"]), -1)
    low = np.searchsorted(est["start"], ref["start"] - start - 1e-9)
    high = np.searchsorted(est["start"], ref["start"] + start + 1e-9, side="right")
    for r in np.flatnonzero(low < high).tolist():
        near = slice(low[r], high[r])
        overlap = np.minimum(est["end"][near], ref["end"][r]) - np.maximum(est["start"][near], ref["start"][r])
        fits = free[near] & (np.abs(est["pitch"][near] - ref["pitch"][r]) <= pitch) & (np.abs(est["start"][near] - ref["start"][r]) <= start) & (overlap > 0)
        if fits.any():
            out[r] = low[r] + int(np.where(fits, overlap, -np.inf).argmax())
            free[out[r]] = False
    return out


def match(reference: DataFrame, estimate: DataFrame, pitch: float = 0.5, start: float = 0.05, width: float | None = None) -> DataFrame:
    """(track, ref_id, est_id): each reference note, by start and id, takes the free estimate that it overlaps most.

    Estimates must be within both tolerances; of equals the one that starts first wins, then the smaller id.
    """
    width = max(TOLERANCES * start, LEAST) if width is None else width
    if width < 2 * start:
        raise ValueError("a span must be at least two tolerances wide")
    number = T.DoubleType()
    side = lambda df, ref: df.select("track", "id", *(F.col(c).cast(number).alias(c) for c in ("pitch", "start", "end")), F.lit(ref).alias("ref"))
    refs = side(reference, True).withColumn("span", F.floor(F.col("start") / width))
    spans = F.sequence(F.floor((F.col("start") - start) / width - 1e-9), F.floor((F.col("start") + start) / width + 1e-9))
    ests = side(estimate, False).withColumn("span", F.explode(spans))
    held = cut(refs.unionByName(ests).repartition("track", "span"))
    key = reference.schema["id"].dataType
    track = reference.schema["track"].dataType
    fields = [T.StructField("track", track), T.StructField("span", T.LongType()), T.StructField("ref_id", key), T.StructField("est_id", key), T.StructField("next", T.BooleanType())]
    schema = T.StructType(fields)

    def work(part: pa.Table) -> pa.Table:
        part = part.sort_by([("start", "ascending"), ("id", "ascending")])
        is_ref, gone = part.column("ref").to_numpy(), part.column("gone").to_numpy()
        span = part.column("span")[0].as_py()
        columns = {c: part.column(c).to_numpy() for c in ("pitch", "start", "end")}
        at_ref, at_est = np.flatnonzero(is_ref), np.flatnonzero(~is_ref)
        found = _take({c: x[at_ref] for c, x in columns.items()}, {c: x[at_est] for c, x in columns.items()}, gone[at_est], pitch, start)
        r, e = at_ref[found >= 0], at_est[found[found >= 0]]
        # whether the span after this one may look at the estimate too
        later = columns["start"][e] + start >= (span + 1) * width - 1e-6
        ids = part.column("id")
        keys = {c: part.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(r), np.int64))) for c in ("track", "span")}
        return pa.table({**keys, "ref_id": ids.take(pa.array(r)), "est_id": ids.take(pa.array(e)), "next": later})

    def worked(rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy("track", "span").applyInArrow(work, schema))

    found = worked(held.withColumn("gone", F.lit(False)))
    # what each span was worked out with: (track, span, est_id) of estimates that the span before took
    known = cut(_border(found).limit(0))
    while True:
        border = cut(_border(found))
        changed = border.exceptAll(known).union(known.exceptAll(border)).select("track", "span").distinct()
        changed = cut(changed)
        if not changed.limit(1).count():
            return found.select("track", "ref_id", "est_id")
        again = held.join(changed, ["track", "span"], "left_semi")
        gone = border.select("track", "span", F.col("est_id").alias("id"), F.lit(False).alias("ref"), F.lit(True).alias("gone"))
        again = again.join(gone, ["track", "span", "id", "ref"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        found = cut(found.join(changed, ["track", "span"], "left_anti").unionByName(worked(again)))
        known = border


def _border(found: DataFrame) -> DataFrame:
    """(track, span, est_id): estimates that each span took which the next may look at."""
    return found.where("next").select("track", (F.col("span") + 1).alias("span"), "est_id")
