"""Language identification by nearest centroid.

A text's vector has the hashed byte 2-, 3- and 4-grams of its lower-cased letters, weighted
log(1 + count) times the inverse document frequency, and is normalised.  Each language has up to
``CLUSTERS`` centroids, from spherical k-means over a sample of at most ``SAMPLE`` labelled texts
in all, or ``LEAST`` of each language if those are more; a value of the column is a language if ``FEWEST``
texts have it, so that typing errors do not make the model grow; document frequencies cover every
training text.  A text gets the language of the centroid of the greatest cosine.

A long text meets every centroid in some buckets by chance, so rejection goes by the centred cosine,
the correlation over buckets, which is near 0 for what the language did not make.  It is held
against ``MARGIN`` times what all but one in a hundred texts of that language and about that many
grams reach; these are the sampled texts and their first 1, 4, 16, 64 and 256 words, each scored by
centroids of the half of the sample that it is not in.

Cases: a null text or one without a letter is ``und`` with score 0, and rejected; with nothing to
learn from, so is every text; ties go to the language first in order; repeated rows are scored
alike; a text of any length is read whole, in a slice of its own; other columns stay, and clashing
ones give way; a null doc_id hashes as an empty one; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import fold, lookup, table

#: Hash buckets of a vector.
WIDTH = 4096
#: Labelled texts that the centroids are fitted on, all languages together, and clusters of each.
SAMPLE, CLUSTERS = 1600, 4
#: Training texts that make a language, and the least sample of each.
FEWEST, LEAST = 2, 8
MARGIN = 0.5
#: Words of the beginnings that floors are set on, and the powers of two of grams that have a floor each.
HEADS, LENGTHS = (1, 4, 16, 64, 256), 24
ROWS = 512


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of the hashed byte n-grams of each text."""
    raw, bounds = K.text_buffer(pc.utf8_lower(texts))
    raw = K.letters_only(raw).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
    out = np.zeros(len(texts) * WIDTH, np.int64)
    h = raw
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        ids = ((h * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        same = row[: len(ids)] == row[n - 1 :]
        out += np.bincount((ids + row[: len(ids)] * WIDTH)[same], minlength=len(out))
    return out.reshape(len(texts), WIDTH)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    floor: np.ndarray
    names: list[str]

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language and cosine of each text, and whether it is too far from that language."""
        x = self.vectors(counts)
        near = x @ self.centroids.T
        best = near.argmax(axis=1)
        lang = self.language[best]
        return lang, near[np.arange(len(best)), best], _centred(x, self.centroids)[np.arange(len(best)), best] < self.floor[lang, _length(counts)]


def _centred(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines once each vector's mean is taken off: 0 for what falls into the buckets by chance."""
    x, c = x - x.mean(axis=1, keepdims=True), centroids - centroids.mean(axis=1, keepdims=True)
    return x @ c.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True) * np.linalg.norm(c, axis=1), 1e-12)


def _length(counts: np.ndarray) -> np.ndarray:
    """The power of two of a text's grams; repeats of a gram count by their logarithm, as they do in the vector."""
    return np.minimum(np.log2(np.maximum(np.log2(1.0 + counts).sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


def _floors(lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The floor of each length; a length that no text has lies between its neighbours."""
    known = np.unique(lengths)
    found = [max(MARGIN * np.quantile(scores[lengths == k], 0.01), 1e-6) for k in known]
    return np.interp(np.arange(LENGTHS), known, found)


def _unpacked(held: bytes) -> np.ndarray:
    """Counts from the buckets that have any, followed by their counts."""
    at, n = np.frombuffer(held, "<u2").reshape(2, -1)
    out = np.zeros(WIDTH, "<u2")
    out[at] = n
    return out


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun from texts that are far from each other."""
    chosen = [x.mean(axis=0)]
    far = 1 - x @ chosen[0]
    centroids = []
    for _ in range(min(k, len(x))):
        centroids.append(x[far.argmax()])
        far = np.minimum(far, 1 - x @ centroids[-1])
    c = np.stack(centroids)
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the texts each bucket occurs: one short row a bucket and task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for part in K.slices(batch, rows=ROWS):
                total += (gram_counts(part.column("text")) > 0).sum(axis=0)
                n += part.num_rows
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1)), pa.array(np.append(total[ids], n))], names=["bucket", "n"])

    found = dict(texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())
    n = found.pop(-1, 0)
    frequency = np.zeros(WIDTH)
    frequency[list(found)] = list(found.values())
    return frequency, n


def fit(documents: DataFrame, train: Column, sample: int = SAMPLE, clusters: int = CLUSTERS, lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the rows where train holds and lang is not null."""
    rows = documents.where(train & F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = dict(rows.groupBy(lang).count().where(F.col("count") >= FEWEST).collect())  # a row for each language of the model
    if not counts:
        return None
    names = sorted(counts)
    each = max(LEAST, sample // len(names))
    draw = F.pmod(F.xxhash64(F.lit("language"), key, F.xxhash64("text")), 1 << 30) / float(1 << 30)
    shares = documents.sparkSession.createDataFrame([(name, min(1.0, each / counts[name])) for name in names], "_lang string, _share double")
    rows = lookup(rows, shares, F.col(lang) == F.col("_lang"), rows=len(names))
    chosen = rows.where(draw < F.col("_share")).select(F.col(lang).alias("lang"), "text", draw.alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, rows=ROWS):
                texts = part.column("text")
                held = np.minimum(gram_counts(texts), 65535).astype("<u2")
                heads = [[] for _ in held]
                for k in HEADS:
                    short = [(i, " ".join(t[:k])) for i, t in enumerate(t.split(None, k) for t in texts.to_pylist()) if len(t) > k]
                    for (i, _), x in zip(short, gram_counts(pa.array([t for _, t in short], pa.string())) if short else []):
                        at = np.flatnonzero(x)
                        heads[i].append(np.concatenate([at, np.minimum(x[at], 65535)]).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("draw"), pa.array([x.tobytes() for x in held], pa.binary()), pa.array(heads, pa.list_(pa.binary()))], names=["lang", "draw", "counts", "heads"])

    # the draw is a bound in expectation; the limit, of the least draws, makes it one for repeated keys too
    found = chosen.mapInArrow(run, "lang string, draw double, counts binary, heads array<binary>")
    drawn = found.orderBy("draw", "lang", "counts").limit(2 * max(sample, LEAST * len(names))).drop("draw").collect()
    drawn.sort(key=lambda r: (r[0], r[1]))
    frequency, n = _frequencies(rows.select("text"))
    model = Model((np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32), np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros((len(names), LENGTHS)), names)
    for i, name in enumerate(names):
        own = [r for r in drawn if r[0] == name]
        if not own:
            continue
        whole = np.stack([np.frombuffer(r[1], "<u2") for r in own])
        x = model.vectors(whole)
        c = _clusters(x, clusters)
        model.centroids = np.concatenate([model.centroids, c])
        model.language = np.concatenate([model.language, np.full(len(c), i)])
        # equal texts are in the same half
        side = np.array([zlib.crc32(r[1]) & 1 for r in own], dtype=bool)
        lengths, scores = [], []
        for half in (side, ~side):
            if not half.any():
                continue
            away = _clusters(x[~half], clusters) if (~half).any() else c
            for j in np.flatnonzero(half):
                held = np.stack([whole[j], *map(_unpacked, own[j][2])])
                held = held[held.sum(axis=1) > 0]
                lengths.append(_length(held))
                scores.append(_centred(model.vectors(held), away).max(axis=1, initial=0))
        lengths, scores = np.concatenate(lengths), np.concatenate(scores)
        if len(lengths):
            model.floor[i] = _floors(lengths, scores)
    return model if len(model.centroids) else None


def identify(documents: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with lang_pred, score and rejected; keep: the columns to carry (all by default)."""
    keep = [c for c in keep or documents.columns if c not in ("lang_pred", "score", "rejected")]
    needed = list(dict.fromkeys([*keep, text]))
    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text, rows=ROWS):
                texts = part.column(text)
                held = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], dtype=bool) & (model is not None)
                names, scores, rejected = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                if held.any():
                    lang, near, far = model.predict(gram_counts(texts.filter(pa.array(held))))
                    names[held] = [model.names[i] for i in lang]
                    scores[held] = np.clip(near, 0, 1)
                    rejected[held] = far
                new = [pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], names=[*keep, "lang_pred", "score", "rejected"])

    return documents.select(*needed).mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(documents.select("doc_id", "text", "lang"), ~held_out)
    return identify(documents.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
