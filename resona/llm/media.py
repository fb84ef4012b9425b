"""Media columns in lossless WebP.

``store`` puts bytes into images of 8-bit samples, 64 to a row; ``pixels`` reads an image column
back as arrays; ``measure`` reads the stored bytes back and computes digests and features.  Bytes
beyond ``IMAGE`` go on in a further image of the same binary value, so that a task's memory does
not grow with a text.

Cases: a null or empty text is stored as 64 zero bytes; equal texts give equal values; repeated
rows are stored each; a text of any length goes on in further images; other columns stay, and
clashing ones give way; an empty table gives none; bytes that are no image raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, LongType

from . import kernels as K
from . import webp
from .frames import table

ROW = 64
#: Bytes of an image: 16,384 rows, the most that the format has.
IMAGE = ROW << 14


def to_images(payload: bytes) -> bytes:
    parts = (np.frombuffer(payload[i : i + IMAGE], np.uint8) for i in range(0, len(payload), IMAGE))
    return b"".join(webp.encode(part.reshape(-1, ROW)) for part in parts)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The (height, width) arrays of ARGB values of the images stored one after the other."""
    at = 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at:end])
        at = end


def store(documents: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with n_bytes and media."""
    keep = [c for c in documents.columns if c not in (text, "n_bytes", "media")]
    schema = documents.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                payloads = [(t or "").encode() for t in part.column(text).to_pylist()]
                media = [to_images(p + b"\0" * (-len(p) % ROW if p else ROW)) for p in payloads]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return documents.select(*keep, text).mapInArrow(run, schema)


def pixels(stored: DataFrame, media: str = "media") -> DataFrame:
    """The other columns with, for each image, its place, width, height and pixels (ARGB values, row after row)."""
    keep = [c for c in stored.columns if c not in (media, "image", "width", "height", "pixels")]
    schema = stored.select(*keep).schema.add("image", "integer").add("width", "integer").add("height", "integer").add("pixels", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, media, rows=64):
                found = [(i, k, x) for i, m in enumerate(part.column(media).to_pylist()) for k, x in enumerate(images(m or b""))]
                row = pa.array([i for i, _, _ in found], pa.int64())
                sizes = [pa.array(x, pa.int32()) for x in ([k for _, k, _ in found], [x.shape[1] for *_, x in found], [x.shape[0] for *_, x in found])]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in keep), *sizes, pa.array([x.reshape(-1) for *_, x in found], pa.list_(pa.int64()))], names=schema.names)

    return stored.select(*keep, media).mapInArrow(run, schema)


def measure(stored: DataFrame, media: str = "media") -> DataFrame:
    """The other columns with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes alone."""
    new = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    keep = [c for c in stored.columns if c not in (media, *new)]
    schema = stored.select(*keep).schema
    for name in new:
        schema = schema.add(name, "string" if name in ("payload_sha256", "media_sha256", "feature") else "long")

    def values(stored_bytes: bytes) -> tuple:
        digest, n, tail, sums, height = sha256(), 0, b"", np.zeros(256, np.int64), 0
        for image in images(stored_bytes):
            samples = (image >> 8).astype(np.uint8)
            body = samples.tobytes()
            digest.update(body)
            n, tail, height = n + len(body), body[-ROW:], height + len(samples)
            sums += np.bincount(samples.reshape(-1), minlength=256)
        # size, mean, distinct samples, and shares in thousandths of four ranges of samples
        shares = "/".join(str(int(x) * 1000 // max(n, 1)) for x in np.add.reduceat(sums, [0, 33, 97, 128]))
        feature = f"{ROW}x{height};mean={int(sums @ np.arange(256)) // max(n, 1)};kinds={np.count_nonzero(sums)};shares={shares}"
        return n, digest.hexdigest(), crc32(tail), len(stored_bytes), sha256(stored_bytes).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, media):
                columns = zip(*(values(m) for m in part.column(media).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, columns)], names=schema.names)

    return stored.select(*keep, media).mapInArrow(run, schema)


def op10_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(store(table(spark, sf_dir, "documents").select("doc_id", "text")))
