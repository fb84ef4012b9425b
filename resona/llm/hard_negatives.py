"""Hard negatives by inner product, with angular triangle filtering.

Every row stores its norm and its angles to ``DIRECTIONS`` reference directions.  If an anchor is at
angle a from a direction and a row at angle b, then the angle between the two is at least |a - b| and
at most the smaller of a + b and a full turn less a + b.  The directions together give an interval of
the angle, its cosines times both norms an interval of the score, widened by more than rounding can
be off.  Only rows whose interval meets the window in question get an integer score:

* an anchor's positives, its best rows of the same label, must reach the k-th largest lower bound;
* a negative for a positive of score p must lie in the window from ``LOW`` of p to p, and reach the
  k-th largest lower bound of the rows whose whole interval lies within that window.

The directions are the centres of a k-means by angle over a sample of at most ``SAMPLE`` rows, taken
by a hash of id and vector; they decide how narrow the intervals are, never what is returned.  Rows are dealt to
the cell of their nearest direction, a cell to blocks of at most some ``BLOCK`` rows by a hash.  Before an
anchor goes to a cell, the same bound over the cell's least and greatest angles and norms must meet one
of its windows.  Anchors are a stated set of queries and stream past each block; a block's rows are
sorted by label and by the angle to the cell's own direction, so a label, or a window of that angle,
is a slice.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part; rows that share
an id are candidates each of its own, but not for each other; anchors with one id but different rows
are anchors each of its own, a repeated row is one anchor; vectors of less components end in zeros; a
vector of zeros scores 0; ties go to the smaller id; with fewer rows than asked for all are returned, and
an anchor without positives, or a positive without negatives, has no rows; a negative positive score has
an empty window; scores are exact at any magnitude, and one beyond 64 bits among the positives
raises ``OverflowError``; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import lookup, stash, table
from .topk_search import _matrix

SCALE = 256
DIRECTIONS, SAMPLE, ROUNDS = 32, 4096, 8
#: Rows of a block, at most on average.
BLOCK = 32_768
#: A window starts at this share of the positive's score, as a numerator and a denominator.
LOW = (4, 5)
#: By how much an angle may be off, that is stored in 32 bits, and a bound as a share of the product of both norms.
ANGLE, SLACK = 2e-6, 4e-6
LONG = 1 << 63


def directions_of(vectors: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors that few of the given ones are far from: k-means by angle, begun with the farthest of those before."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((1, vectors.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(ROUNDS):
        own = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def angles_to(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The angle of each vector to each direction; a vector of zeros counts as at a right angle to all."""
    units = vectors / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(units @ directions.T, -1, 1))


def bounds(angles: np.ndarray, norms: np.ndarray, own: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that rows at these angles can have with a vector at its own angles."""
    low = np.abs(angles - own).max(axis=1) - ANGLE
    both = angles + own
    high = np.minimum(both, 2 * np.pi - both).min(axis=1) + ANGLE
    size = norms * norm
    slack = SLACK * size + 1
    return np.cos(np.minimum(high, np.pi)) * size - slack, np.cos(np.maximum(low, 0)) * size + slack


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles: 64-bit integers, or Python's where a sum could be inexact."""
    if float(np.abs(query).max(initial=0.0)) * float(np.abs(vectors).max(initial=0.0)) * max(len(query), 1) < 1 << 53:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in vectors.tolist()] + [None], dtype=object)[:-1]


def best(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id."""
    if found.dtype == object:
        return np.array(sorted(range(len(found)), key=lambda i: (-found[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -found))[:k]


class Block:
    """Rows of one cell, by label and by the angle to the cell's direction."""

    def __init__(self, cell: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray, angles: np.ndarray):
        order = np.lexsort((angles[:, cell], labels))
        self.cell, self.ids, self.labels, self.vectors, self.norms, self.angles = cell, *(x[order] for x in (ids, labels, vectors, norms, angles))
        self.cuts = [0, *(np.flatnonzero(np.diff(self.labels)) + 1).tolist(), len(order)]
        self.greatest = float(norms.max(initial=0.0))

    def positives(self, anchor: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(*np.searchsorted(self.labels, [anchor["label"], anchor["label"] + 1]))
        at = at[self.ids[at] != anchor["vec_id"]]
        low, high = bounds(self.angles[at], self.norms[at], anchor["angles"], anchor["norm"])
        if len(at) > k:
            at = at[high >= np.partition(low, -k)[-k]]
        found = scores(self.vectors[at], anchor["vector"])
        top = best(found, self.ids[at], k)
        return self.ids[at][top], found[top]

    def negatives(self, anchor: dict, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window, ids and scores of the k best rows of other labels within it."""
        least, most = min(w[0] for w in windows), max(w[1] for w in windows)
        # how far from the anchor's angle to the cell's direction a row can be and still reach the least score
        size = self.greatest * anchor["norm"]
        reach = (least - SLACK * size - 1) / size if size else 0.0
        turn = np.arccos(min(1.0, max(-1.0, reach))) + ANGLE
        parts, own = [], anchor["angles"][self.cell]
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            if b > a and self.labels[a] != anchor["label"]:
                parts.append(a + np.arange(*np.searchsorted(self.angles[a:b, self.cell], [own - turn, own + turn])))
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        at = at[self.ids[at] != anchor["vec_id"]]
        low, high = bounds(self.angles[at], self.norms[at], anchor["angles"], anchor["norm"])
        asked = np.zeros(len(at), bool)
        for a, b in windows:
            meets = (high >= a) & (low <= b)
            sure = low[meets & (low >= a) & (high <= b)]
            if len(sure) > k:
                meets &= high >= np.partition(sure, -k)[-k]
            asked |= meets
        at = at[asked]
        found, ids = scores(self.vectors[at], anchor["vector"]), self.ids[at]
        out = []
        for a, b in windows:
            held = np.flatnonzero((found >= a) & (found <= b))
            top = held[best(found[held], ids[held], k)]
            out.append((ids[top], found[top]))
        return out


def _index(held: DataFrame, directions: np.ndarray, dims: int) -> DataFrame:
    """The rows with norm, angles and cell."""
    schema = T.StructType([*held.schema.fields, T.StructField("norm", T.DoubleType()), T.StructField("angles", T.ArrayType(T.FloatType())), T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dims)
            norms = np.linalg.norm(vectors, axis=1)
            angles = angles_to(vectors, norms, directions)
            made = [pa.array(norms), pa.FixedSizeListArray.from_arrays(pa.array(angles.astype(np.float32).reshape(-1)), len(directions)).cast(pa.list_(pa.float32())), pa.array(np.argmin(angles, axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "norm", "angles", "cell"])

    return held.mapInArrow(run, schema)


def _past_blocks(rows: DataFrame, anchors: DataFrame, dims: int, answer: Callable, schema: str) -> DataFrame:
    """Rows and anchors, both with cell and block, meet; answer(block, anchors) gives the columns of a batch of results."""
    none = [F.lit(None).cast(t).alias(n) for n, t in anchors.dtypes if n not in rows.columns]
    left = rows.select(*rows.columns, F.lit(False).alias("asks"), *none)
    right = anchors.select(*rows.columns, F.lit(True).alias("asks"), *(n for n in anchors.columns if n not in rows.columns))
    dealt = left.union(right).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

    def columns(part: pa.RecordBatch) -> dict:
        made = {c: part.column(c) for c in part.schema.names}
        made |= {c: part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm")}
        return made | {"vector": _matrix(part.column("vector"), dims), "angles": _matrix(part.column("angles"), len(part.column("angles")[0]) if len(part) else 0)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block the rows come first; its anchors pass by in batches."""
        at, parts, block = None, [], None
        for batch in batches:
            cells, blocks, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "asks"))
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                if b == a:
                    continue
                part = columns(batch.slice(a, b - a))
                if (key := (cells[a], blocks[a])) != at:
                    at, parts, block = key, [], None
                if not asked[a]:
                    parts.append([part[c] for c in ("vec_id", "label", "vector", "norm", "angles")])
                    continue
                if block is None and parts:
                    block, parts = Block(int(cells[a]), *(np.concatenate(x) for x in zip(*parts, strict=True))), []
                if block is not None:
                    yield from answer(block, part)

    return dealt.mapInArrow(run, schema)


def mine(embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = 5, k: int = 5, low: tuple[int, int] = LOW, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    positives the k best rows of other labels with scores from ``low`` of the positive's to the positive's."""
    spark = embeddings.sparkSession
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & label.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale < float(1 << 53), F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    held = embeddings.where(whole).select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), ints.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    dims = held.agg(F.max(F.size("vector"))).first()[0] or 0
    sample = held.select("vector", F.xxhash64("vec_id", "vector").alias("_h")).orderBy("_h").limit(SAMPLE).select("vector")
    drawn = np.zeros((0, dims))
    if rows := sample.collect():
        drawn = np.array([[*r[0], *[0.0] * (dims - len(r[0]))] for r in rows])
    directions = directions_of(drawn)
    rows = stash(_index(held, directions, dims))

    # a row for each direction, each with the least and greatest angles of its cell: a table of bounded size
    ends = [f(F.col("angles")[i]) for f in (F.min, F.max) for i in range(len(directions))]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.array(*ends[: len(directions)]).alias("low"), F.array(*ends[len(directions) :]).alias("high")).collect()
    blocks = {r["cell"]: max(1, -(-r["n"] // block)) for r in cells}
    of = spark.createDataFrame(sorted(blocks.items()), "cell int, blocks int")
    dealt = lookup(rows.drop("_anchor"), of, "cell", rows=len(blocks)).withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int")).drop("blocks")
    anchors = rows.where("_anchor").drop("_anchor", "cell").dropDuplicates(["vec_id", "label", "vector"]).withColumn("row", F.xxhash64("label", "vector"))

    def everywhere(anchors: DataFrame) -> DataFrame:
        """Anchors at all blocks of the cells that they list."""
        listed = anchors.withColumn("cell", F.explode("cells")).drop("cells")
        listed = lookup(listed, of, "cell", rows=len(blocks))
        return listed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def find(held: Block, part: dict) -> Iterator[pa.RecordBatch]:
        found = [held.positives({c: part[c][i] for c in ("vec_id", "label", "vector", "norm", "angles")}, positives) for i in range(len(part["vec_id"]))]
        sizes = [len(ids) for ids, _ in found]
        for (_, s), i in zip(found, part["vec_id"], strict=True):
            if any(not -LONG <= x < LONG for x in s.tolist()):
                raise OverflowError(f"a score among the best of anchor {i} does not fit 64 bits")
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(part["vec_id"], sizes)), pa.array(np.repeat(part["row"].to_numpy(), sizes)),
            *(pa.array(np.concatenate([f[j] for f in found]).astype(np.int64)) for j in (0, 1)),
        ], names=["vec_id", "row", "positive_id", "positive_score"])

    every = anchors.withColumn("cells", F.array(*(F.lit(c) for c in sorted(blocks))).cast("array<int>"))
    near = _past_blocks(dealt, everywhere(every), dims, find, "vec_id long, row long, positive_id long, positive_score long")
    first = Window.partitionBy("vec_id", "row").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    listed = near.groupBy("vec_id", "row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    asking = stash(anchors.join(listed, ["vec_id", "row"]))

    edges = {r["cell"]: (r["norm"], np.array(r["low"]), np.array(r["high"])) for r in cells}

    def windows(found: list[dict]) -> list[tuple[int, int]]:
        """The windows of scores of an anchor's positives, where they are not empty."""
        return [(-(-low[0] * p["positive_score"] // low[1]), p["positive_score"]) for p in found if p["positive_score"] >= 0]

    def highest(edge: tuple, own: np.ndarray, size: float) -> float:
        """A score that no row of a cell exceeds."""
        norm, lo, hi = edge
        apart = np.maximum(lo - own, own - hi).max() - ANGLE
        return (max(0.0, float(np.cos(max(0.0, apart)))) + SLACK) * norm * size + 1

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that may hold a row within a window of the anchor."""
        for batch in batches:
            angles, norms = _matrix(batch.column("angles"), len(directions)), batch.column("norm").to_numpy()
            cells_of = []
            for own, size, found in zip(angles, norms, batch.column("positives").to_pylist(), strict=True):
                least = min((w[0] for w in windows(found)), default=None)
                cells_of.append([c for c, edge in edges.items() if least is not None and highest(edge, own, size) >= least])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    def take(held: Block, part: dict) -> Iterator[pa.RecordBatch]:
        out = []
        for i, found in enumerate(part["positives"].to_pylist()):
            found = [p for p in found if p["positive_score"] >= 0]
            if not found:
                continue
            answers = held.negatives({c: part[c][i] for c in ("vec_id", "label", "vector", "norm", "angles")}, windows(found), k)
            for p, (ids, s) in zip(found, answers, strict=True):
                out += [(int(part["vec_id"][i]), part["row"][i].as_py(), p["place"], p["positive_id"], p["positive_score"], n, int(x)) for n, x in zip(ids.tolist(), s.tolist(), strict=True)]
        if out:
            names = ["vec_id", "row", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    pruned = asking.mapInArrow(prune, T.StructType([*asking.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    far = _past_blocks(dealt, everywhere(pruned), dims, take, "vec_id long, row long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("vec_id", "row", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, label)


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vector
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same,
         list_sum(list_transform(list_zip(a.vector, c.vector), lambda p: p[1] * p[2]))::bigint as score
  from v a join v c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, positive_id, s.vec_id as negative_id, positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same
  where 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
