"""Exact top-k search by inner product, with impact-ordered postings, a score at a time.

Vectors are quantised to integers and dealt to blocks by a hash of their id.  A block's postings are
built once: every dimension's are cut into segments by quantised magnitude.  The queries stream past
them.  A query takes the segments by descending impact, its own weight times the segment's greatest
magnitude, and adds products to the accumulators.  For each vector it also adds up the squares that
these postings use, of query and vector: by Cauchy and Schwarz, what is still missing is at most the
root of the product of the squares left.  After each round the best so far are scored exactly, which
gives a score that the k-th best reaches; a vector whose bound is below it is ruled out for good.
Once these proofs leave one in ``FEW`` as a possible member, or all postings are used, the possible
members are scored exactly.  The blocks' best are then merged.

Accumulators and bounds are doubles; the bounds are widened by more than these can be off at any
magnitude.  Exact scores are products of doubles where all their sums are below 2**53, else of
Python's integers.

Cases: vectors that are null, or hold a null or non-finite component, and rows without an id take no
part; rows that share an id are candidates, and queries, each of its own, but not for each other, and
a query id's best come from all of its rows; shorter vectors end in zeros; ties go to the smaller id,
in and across blocks; with fewer than k others all are returned; a score among the best that does not
fit 64 bits raises ``OverflowError``; vectors are as long as their table makes them, and a task holds
a block of them; columns other than the two named are not read, so their names cannot clash; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import table

SCALE = 256
#: Vectors of a block, at least and at most; in between there are two blocks for each core.
LEAST_BLOCK, BLOCK = 4096, 65_536
#: Magnitudes that a dimension's postings are told apart by, and rounds that take them all.
LEVELS, ROUNDS = 32, 10
#: One in so many vectors of a block may be left as possible members when they are scored exactly.
FEW = 32
#: Share of the product of two norms by which a sum or a bound of doubles may be off.
SLACK = 1e-6
LONG = 1 << 63


class Postings:
    """A block's vectors by dimension and magnitude; components are integers held as doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = float(np.abs(vectors).max(initial=0.0))
        # for the bounds, vectors are brought to at most 1 by a power of two, so that squares stay finite
        self.unit = np.exp2(np.ceil(np.log2(self.most))) if self.most else 1.0
        scaled = vectors / self.unit
        self.squares = (scaled**2).sum(axis=1)
        n, dims = vectors.shape
        level = np.minimum(np.abs(vectors) * (LEVELS / max(self.most, 1.0)), LEVELS - 1).astype(np.int64)
        order = np.argsort(level, axis=0, kind="stable").T
        self.rows = order.reshape(-1)
        self.values = np.take_along_axis(scaled.T, order, axis=1).reshape(-1)
        sizes = np.stack([np.bincount(level[:, d], minlength=LEVELS) for d in range(dims)]) if dims else np.zeros((0, LEVELS), np.int64)
        self.starts = (np.cumsum(sizes, axis=1) - sizes + n * np.arange(dims)[:, None]).reshape(-1)
        self.sizes = sizes.reshape(-1)
        self.greatest = np.tile((np.arange(LEVELS) + 1) / LEVELS, dims)

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The scores of the vectors at these places: 64-bit integers, or Python's where those could not hold a sum."""
        if float(np.abs(query).max(initial=0.0)) * self.most * max(len(query), 1) < 1 << 53:
            return (self.vectors[at] @ query).astype(np.int64)
        q = [int(x) for x in query]
        return np.array([sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in self.vectors[at].tolist()] + [None], dtype=object)[:-1]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best."""
        n, dims = self.vectors.shape
        unit = np.exp2(np.ceil(np.log2(np.abs(query).max()))) if query.any() else 1.0
        weight = query / unit
        whole = float(weight @ weight)
        slack = SLACK * np.sqrt(whole * self.squares)
        impact = np.repeat(np.abs(weight), LEVELS) * self.greatest
        order = np.argsort(-impact, kind="stable")
        order = order[(self.sizes[order] > 0) & (impact[order] > 0)]
        ends = np.cumsum(self.sizes[order])
        score, used, seen = np.zeros(n), np.zeros(n), np.zeros(n)
        members, at = np.flatnonzero(self.ids != query_id), 0
        while at < len(order) and len(members) > max(k, n // FEW):
            # no proof comes of the first few tenths, so they are one round
            to = max(at + 1, int(np.searchsorted(ends, ends[at - 1] + n * dims // ROUNDS if at else 3 * n * dims // ROUNDS)))
            segments = order[at:to]
            sizes = self.sizes[segments]
            places = np.arange(sizes.sum()) + np.repeat(self.starts[segments] - (np.cumsum(sizes) - sizes), sizes)
            rows, values, w = self.rows.take(places), self.values.take(places), np.repeat(weight[segments // LEVELS], sizes)
            score += np.bincount(rows, w * values, n)
            used += np.bincount(rows, np.multiply(w, w, out=w), n)
            seen += np.bincount(rows, np.multiply(values, values, out=values), n)
            at = to
            missing = np.sqrt(np.maximum(whole - used, 0) * np.maximum(self.squares - seen, 0)) + slack
            best = members[np.argpartition(-score[members], min(4 * k, len(members) - 1))[: 4 * k]]
            if len(best) >= k:
                reached = np.sort(self.exact(query, best))[-k] / unit / self.unit
                members = members[score[members] + missing[members] >= reached]
        exact = self.exact(query, members)
        top = sorted(range(len(members)), key=lambda i: (-exact[i], self.ids[members[i]]))[:k] if exact.dtype == object else np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members][top], exact[top]


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows, with zeros to their end; components beyond ``dims`` are left out."""
    sizes = vectors.value_lengths().to_numpy()
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, held = np.zeros((len(vectors), dims)), at < dims
    out[np.repeat(np.arange(len(vectors)), sizes)[held], at[held]] = vectors.flatten().to_numpy()[held]
    return out


def search(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of all other rows for each query row."""
    whole = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # exact in a double: a product with a power of two, and what is beyond 2**53 has no fraction
    ints = F.transform(vector, lambda x: F.when(F.abs(x.cast("double")) * scale < float(1 << 53), F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    held = embeddings.where(whole).select(F.col(key).cast("long").alias("vec_id"), ints.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_query"))
    n, dims = held.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = dims or 0
    cores = embeddings.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // min(max(LEAST_BLOCK, n // (2 * cores)), BLOCK)))
    vectors = held.select(F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "vector")
    asks = held.where("_query").select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "vector")
    dealt = vectors.union(asks).repartition(2 * blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block the vectors come first; its queries pass by in batches."""
        block, parts, postings = None, [], None
        for batch in batches:
            of, asked = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if b == a:
                    continue
                ids, part = batch.column("vec_id").slice(a, b - a).to_numpy(), _matrix(batch.column("vector").slice(a, b - a), dims)
                if of[a] != block:
                    block, parts, postings = of[a], [], None
                if not asked[a]:
                    parts.append((ids, part))
                    continue
                if postings is None and parts:
                    postings, parts = Postings(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                if postings is None:
                    continue
                found = [(i, *postings.search(i, q, k)) for i, q in zip(ids.tolist(), part, strict=True)]
                for i, best, scores in found:
                    if any(not -LONG <= s < LONG for s in scores.tolist()):
                        raise OverflowError(f"a score of query {i}, among those of {best.tolist()}, does not fit 64 bits")
                sizes = [len(best) for _, best, _ in found]
                columns = [np.repeat(ids, sizes), *(np.concatenate([f[j] for f in found]).astype(np.int64) for j in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vector
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
