"""Toxicity: a factorization machine over hashed terms.

The terms of a text are 64-bit hashes of its lower-cased words of letters and of their first four
and five bytes; that a term comes at least ``LEVELS`` times is a term of its own.  The machine has a weight
for each feature and, as inner products of ``RANK`` factors, one for each pair of features.  Two tests on the
training rows choose the features:

* alone: log-likelihood ratio of term and label, of either sign, at a false discovery rate of ``FALSE``, of all
  terms in at least ``LEAST`` texts;
* in pairs: the score test of a pair's weight given a machine without pairs, at ``FALSE`` by Bonferroni, of
  all pairs of words that ``SUPPORT`` toxic texts have; a pair that fewer have is too rare to pass.  So a
  word that tells nothing alone, such as the mention of a group, is a feature if it does beside another,
  however many others there are.  The pairs are dealt to tasks as tiles of a matrix.

It is fitted on at most ``SAMPLE`` labelled rows, drawn by a hash of doc_id, equal texts once; what
passes the driver, the sample's terms, is bounded by it.  Scoring reads every text whole.

Cases: a null or empty text, and any text when nothing can be learned, gets the score of a text
without features; several labels of one doc_id, or of equal texts, count as toxic if one is; terms of
equal evidence go by their hash; a text of any length is read in one slice of its own; repeated rows
are scored alike; other columns stay; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, fold, table

#: Labelled rows that the model is fitted on, and pair factors.
SAMPLE, RANK = 20_000, 8
#: Texts that a term needs for the first test, toxic texts that a word needs for the second, and words of a tile.
LEAST, SUPPORT, TILE = 3, 8, 1024
#: Counts of a term from which on it is another term too.
LEVELS = (2, 4)
#: Rate of false features that the tests allow, and the score from which a text is predicted toxic.
FALSE, THRESHOLD = 0.1, 0.3
#: Texts of a step of learning.
BATCH = 2048
PREFIXES = (4, 5)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word of every text, repeats included."""
    return _terms(texts, ())


def _terms(texts: pa.Array, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    raw, bounds = K.text_buffer(texts)
    raw = K.letters_only(raw)
    starts, ends, rows = K.word_bounds(raw, bounds)
    row = np.repeat(np.arange(len(texts)), np.diff(rows))
    hashes, at = [K.word_hashes(raw, starts, ends)], [row]
    for size in prefixes:
        long = ends - starts > size
        hashes.append(K.word_hashes(raw, starts[long], starts[long] + size, seed=size))
        at.append(row[long])
    return np.concatenate(at), np.concatenate(hashes)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of every text, each once."""
    at, hashes = _terms(texts, PREFIXES)
    order = np.lexsort((hashes, at))
    at, hashes = at[order], hashes[order]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1]))[: len(at)])
    count = np.diff(np.append(first, len(at)))
    at, hashes = at[first], hashes[first]
    often = [(at[count >= k], K.mix(hashes[count >= k] + np.uint64(k))) for k in LEVELS]
    return np.concatenate([at, *(o[0] for o in often)]), np.concatenate([hashes, *(o[1] for o in often)])


@dataclass
class Model:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """For n texts, given the distinct features of each."""
        linear = np.bincount(rows, self.weights[ids], n)
        pairs = np.zeros(n)
        for f in self.factors.T:
            pairs += np.bincount(rows, f[ids], n) ** 2 - np.bincount(rows, f[ids] ** 2, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -40, 40)))


class Finder:
    """Positions of hashes in a sorted list; most hashes are ruled out by their low bits."""

    def __init__(self, listed: np.ndarray):
        self.listed, self.maybe = listed, np.zeros(1 << 16, dtype=bool)
        self.maybe[(listed & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, position) of the hashes that are listed."""
        if not len(self.listed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        rows, hashes = rows[held], hashes[held]
        at = np.minimum(np.searchsorted(self.listed, hashes), len(self.listed) - 1)
        held = self.listed[at] == hashes
        found = np.unique(rows[held] * len(self.listed) + at[held])
        return found // len(self.listed), found % len(self.listed)


def _learn(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, listed: np.ndarray, rank: int, rounds: int = 300) -> Model:
    """Adam on the logistic loss, each step on the texts of one of a few fixed batches; factors begin at small fixed values."""
    m, rng = len(listed), np.random.default_rng(42)
    base = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    theta = [np.array([np.log(base / (1 - base))]), np.zeros(m), rng.normal(0, 0.01, (m, rank))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    batches, dealt, place = [], -(-len(labels) // BATCH), rng.permutation(len(labels))
    for k in range(dealt):
        chosen = np.flatnonzero(place[rows] % dealt == k)
        own, at = np.unique(rows[chosen], return_inverse=True)
        rest = np.setdiff1d(np.flatnonzero(place % dealt == k), own)
        batches.append((at, ids[chosen], labels[np.concatenate([own, rest])]))
    for step in range(1, rounds + 1):
        (at, of, truth), (bias, weights, factors) = batches[step % dealt], theta
        n = len(truth)
        sums = np.stack([np.bincount(at, f[of], n) for f in factors.T], axis=1) if rank else np.zeros((n, 0))
        squares = np.bincount(at, (factors[of] ** 2).sum(axis=1), n)
        z = bias[0] + np.bincount(at, weights[of], n) + ((sums**2).sum(axis=1) - squares) / 2
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth) / n
        per = slope[at]
        pulls = np.stack([np.bincount(of, per * sums[at, f], m) for f in range(rank)], axis=1) if rank else np.zeros((m, 0))
        own = np.bincount(of, per, m)
        gradients = [np.array([slope.sum()]), own + 1e-6 * weights, pulls - own[:, None] * factors + 1e-5 * factors]
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - 0.05 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    return Model(listed, float(theta[0][0]), theta[1], theta[2])


def _discovered(evidence: np.ndarray, tested: int) -> int:
    """How many of the likelihood ratios, greatest first, pass at a false discovery rate of FALSE among those tested (Benjamini and Hochberg)."""
    chance = np.array([erfc(sqrt(max(e, 0.0) / 2)) for e in evidence])
    passed = np.flatnonzero(chance <= FALSE * np.arange(1, len(chance) + 1) / max(tested, 1))
    return int(passed[-1]) + 1 if len(passed) else 0


def _in_pairs(spark: SparkSession, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, expected: np.ndarray, m: int) -> np.ndarray:
    """Which of m features have a pair whose weight is not 0, given what a machine without pairs expects of each text; a task has a tile of the pairs."""
    if m < 2:
        return np.zeros(m, bool)
    limit = NormalDist().inv_cdf(1 - FALSE / (m * (m - 1) // 2) / 2)
    of = np.argsort(ids, kind="stable")
    shared = spark.sparkContext.broadcast((rows[of].astype(np.int32), ids[of].astype(np.int32), (labels - expected).astype(np.float32), (expected * (1 - expected)).astype(np.float32)))
    tiles = -(-m // TILE)

    def tile(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        rows, ids, pulls, spreads = shared.value
        parts = []
        for k in (i, j):
            a, b = np.searchsorted(ids, [k * TILE, (k + 1) * TILE])
            order = np.argsort(rows[a:b], kind="stable")
            parts.append((rows[a:b][order], ids[a:b][order] - k * TILE))
        pull, spread = np.zeros((TILE, TILE), np.float32), np.zeros((TILE, TILE), np.float32)
        for at in range(0, len(pulls), BATCH):
            one, other = (np.zeros((BATCH, TILE), np.float32) for _ in parts)
            for there, (r, c) in zip((one, other), parts, strict=True):
                a, b = np.searchsorted(r, [at, at + BATCH])
                there[r[a:b] - at, c[a:b]] = 1
            n = min(BATCH, len(pulls) - at)
            pull += one[:n].T @ (other[:n] * pulls[at : at + n, None])
            spread += one[:n].T @ (other[:n] * spreads[at : at + n, None])
        strong = np.abs(pull) > limit * np.sqrt(spread + 1)
        if i == j:
            np.fill_diagonal(strong, False)
        x, y = np.nonzero(strong)
        return np.unique(x) + i * TILE, np.unique(y) + j * TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tile(i, j)), pa.int64())], names=["feature"])

    work = spark.range(tiles).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(tiles - 1))).alias("j"))
    found = work.repartition(max(1, tiles * (tiles + 1) // 2), "i", "j").mapInArrow(run, "feature long").distinct().collect()
    out = np.zeros(m, bool)
    out[[r[0] for r in found]] = True
    return out


def _longs(found: DataFrame) -> np.ndarray:
    return np.array([r[0] for r in found.collect()], np.int64).view(np.uint64)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, key: str = "doc_id") -> Model:
    """A model of labels (doc_id, toxic) for documents (doc_id, text)."""
    held = labels.where("toxic is not null").select(F.col(key).alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    share = sample / max(1, held.count())
    drawn = held.where(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), 1 << 30) / float(1 << 30) < share)
    drawn = cut(drawn.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(2 * sample))
    documents = documents.select(key, "text")
    rows = documents.join(F.broadcast(drawn), documents[key] == drawn["_id"]).where("text is not null")  # at most 2 * sample rows of 12 bytes
    # one row of equal texts, whichever comes first
    rows = cut(rows.groupBy(F.xxhash64("text").alias("row")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, limit=8 << 20):
                at, hashes = terms(part.column("text"))
                order = np.argsort(hashes, kind="stable")
                at, hashes = at[order], hashes[order]
                toxic = part.column("toxic").to_numpy()[at]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
                if len(first):
                    n, t = np.diff(np.append(first, len(hashes))), np.add.reduceat(toxic, first)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(n), pa.array(t.astype(np.int64))], names=["term", "n", "t"])

    n, t = (x or 0 for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < t < n:
        return Model(np.zeros(0, np.uint64), -4.0 if not t else 4.0, np.zeros(0), np.zeros((0, rank)))
    by_term = rows.mapInArrow(counts, "term long, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST)
    ratio = lambda a, b: F.when((a > 0) & (b > 0), a * F.ln(F.try_divide(a, b))).otherwise(0.0)
    there, away = F.col("t").cast("double"), F.lit(float(t)) - F.col("t")
    there0, away0 = (F.col("n") - F.col("t")).cast("double"), F.lit(float(n - t)) - (F.col("n") - F.col("t"))
    in_, out = F.col("n") / float(n), 1 - F.col("n") / float(n)
    evidence = 2 * (ratio(there, in_ * float(t)) + ratio(away, out * float(t)) + ratio(there0, in_ * float(n - t)) + ratio(away0, out * float(n - t)))
    tested = cut(by_term.select("term", "n", evidence.alias("e")))
    # no evidence below that of FALSE for one term alone can pass
    best = tested.where(F.col("e") >= NormalDist().inv_cdf(1 - FALSE / 2) ** 2).orderBy(F.desc("e"), "term").select("term", "e").collect()
    alone = np.array([r[0] for r in best], np.int64).view(np.uint64)[: _discovered(np.array([r[1] for r in best]), tested.count())]

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                at, hashes = words(part.column("text"))
                order = np.lexsort((at, hashes))
                at, hashes = at[order], hashes[order]
                new = np.append(True, (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1]))[: len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64))], names=["term"])

    often = _longs(rows.where("toxic = 1").mapInArrow(spoken, "term long").groupBy("term").count().where(F.col("count") >= SUPPORT).select("term"))
    listed = np.union1d(alone, often)
    find = Finder(listed)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch):
                at, ids = find(*terms(part.column("text")))
                held_ids = [x.tobytes() for x in np.split(ids.astype("<i4"), np.searchsorted(at, np.arange(1, part.num_rows)))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("toxic"), pa.array(held_ids, pa.binary())], names=["row", "toxic", "ids"])

    fitted = sorted(rows.mapInArrow(present, "row long, toxic int, ids binary").collect())
    sizes, truth = np.array([len(r[2]) // 4 for r in fitted]), np.array([r[1] for r in fitted], float)
    at, ids = np.repeat(np.arange(len(fitted)), sizes), np.frombuffer(b"".join(r[2] for r in fitted), "<i4").astype(np.int64)

    def among(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(listed), -1)
        place[np.searchsorted(listed, chosen)] = np.arange(len(chosen))
        held = place[ids] >= 0
        return at[held], place[ids[held]]

    alone_only = _learn(*among(np.sort(alone)), truth, np.sort(alone), 0, 100)
    paired = np.unique(often)
    both = _in_pairs(documents.sparkSession, *among(paired), truth, alone_only.score(*among(np.sort(alone)), len(truth)), len(paired))
    chosen = np.union1d(alone, paired[both])
    return _learn(*among(chosen), truth, chosen, rank)


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The other columns with score and predicted."""
    keep = [c for c in documents.columns if c not in (text, "score", "predicted")]
    schema = documents.select(*keep).schema.add("score", "double").add("predicted", "integer")
    find = Finder(model.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                scores = model.score(*find(*terms(part.column(text))), part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return documents.select(*keep, text).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = fit(documents.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return score(documents.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), model)
