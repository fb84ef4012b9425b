"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set if it is set in over half of the XXH64 hashes of a text's 4-word
shingles.  Fingerprints link at ``RADIUS`` or fewer differing bits, and the links' components are
the groups.

Equal fingerprints are one node.  Two that link agree on all but ``RADIUS`` of any blocks of their
bits, so nodes meet in buckets keyed by the blocks left; the more nodes there are, the more blocks,
so that buckets stay small without losing a link.  Within a bucket every node has a row of the
pivot table, its distances to ``PIVOTS`` reference fingerprints.  By the triangle inequality, no
pair whose rows differ by more than ``RADIUS`` in any column can link; the pairs that survive are
verified on the fingerprints.  A bucket of over ``BUCKET`` nodes is cut into chunks, and each pair
of chunks is a task's work of its own.  A bucket yields the star of each of its components, not its
pairs; alternating large and small stars then join them across buckets.

Cases: a null or blank text has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle; a component is named by its smallest non-null doc_id, null if it has
none; repeated rows get the same values; a text of any length is hashed whole, in a slice of its own;
other columns stay, and clashing ones give way; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, lookup, salted, table

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Columns of the pivot table.
PIVOTS = 16
#: Nodes of a bucket that one task compares with each other.
BUCKET = 1024


def fingerprint_batch(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    raw, bounds = K.text_buffer(texts)
    raw = K.lower_ascii(raw)
    starts, ends, rows = K.word_bounds(raw, bounds)
    if not len(starts):
        return np.zeros(len(texts), np.uint64)
    text, at = K.joined(raw, starts, ends)
    n_words = np.diff(rows)
    n = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    first = np.arange(edges[-1]) + np.repeat(rows[:-1] - edges[:-1], n)
    after = np.minimum(first + shingle, np.repeat(rows[1:], n))
    hashes = K.xxh64(text, at[first], at[after] - 1, seed)
    bits = 2 * K.bit_sums(hashes, edges) > n[:, None]
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """The other columns, and the fingerprint as a long."""
    others = [c for c in documents.columns if c not in (text, "fingerprint")]
    schema = documents.select(*others).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                prints = fingerprint_batch(part.column(text)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(prints)], names=[*others, "fingerprint"])

    return documents.select(*others, text).mapInArrow(run, schema)


def _blocks(nodes: int, radius: int) -> tuple[list[int], int]:
    """The block masks, and how many blocks a key has, so that a key meets few unrelated nodes."""
    for count in range(radius + 1, 2 * radius + 1):
        width = 64 * (count - radius) // count
        if nodes >> width <= 256:
            break
    cuts = [64 * i // count for i in range(count + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)], count - radius


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(prints: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to fixed reference fingerprints."""
    reference = K.mix(np.arange(1, pivots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.bitwise_count(prints[:, None] ^ reference[None, :]).astype(np.int8)


def bucket_stars(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (centre, node) that connect the same nodes as all links within groups of equal, adjacent ids."""
    table_ = pivot_table(prints)
    label = np.arange(len(prints))
    at = np.arange(len(prints))
    for step in range(1, len(prints)):
        at = at[at + step < len(prints)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.abs(table_[at] - table_[at + step]).max(axis=1) <= radius]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= radius]
        a, b = label[near], label[near + step]
        while (open_ := a != b).any():
            low, high = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(label, high, low)
            while (down := label[label]).tobytes() != label.tobytes():
                label = down
            a, b = label[near], label[near + step]
    held = np.flatnonzero(label != np.arange(len(label)))
    return prints[label[held]], prints[held]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints within the radius."""
    masks, held = _blocks(nodes.count(), radius)
    keys = [sum(chosen) for chosen in combinations(masks, held)]
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(keys))))
    rows = nodes.select("fingerprint", key.alias("key")).select("key.kind", "key.value", "fingerprint")
    sizes = rows.groupBy("kind", "value").count().where("count > 1")
    many = cut(sizes.where(F.col("count") > bucket).select(F.col("kind").alias("_k"), F.col("value").alias("_v"), F.ceil(F.col("count") / bucket).cast("int").alias("chunks")))
    rows = lookup(rows, many, (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v")), "left").drop("_k", "_v")
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("chunks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    rows = rows.select("kind", "value", "fingerprint", F.explode(pairs).alias("pair")).select("kind", "value", "pair.i", "pair.j", "fingerprint")
    work = rows.repartition("kind", "value", "i", "j").sortWithinPartitions("kind", "value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_prints = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)

        def stars(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))]) if len(keys) else np.zeros(0, np.int64)
            u, v = bucket_stars(group, prints, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                keys = np.concatenate([held_keys, np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("kind", "value", "i", "j")], axis=1)])
                prints = np.concatenate([held_prints, part.column("fingerprint").to_numpy().view(np.uint64)])
                same = (keys == keys[-1]).all(axis=1)
                last = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
                if last:
                    yield stars(keys[:last], prints[:last])
                held_keys, held_prints = keys[last:], prints[last:]
        if len(held_keys):
            yield stars(held_keys, held_prints)

    return work.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component, for nodes on edges other than roots."""
    edges, seen = cut(edges), None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(lowest, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The other columns with fingerprint (long) and component_id."""
    others = [c for c in documents.columns if c not in (text, "fingerprint", "component_id")]
    # the columns that stay are packed away, so that none clashes with those of the work
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    prints = cut(fingerprints(packed))
    nodes = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("_low")))
    roots = components(links(nodes.select("fingerprint"), radius))
    named = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "_low", F.coalesce("root", "fingerprint").alias("root"))
    # a component may hold a large share of all nodes: they are added up before the shuffle, and the way back is salted
    lows = named.groupBy("root").agg(F.count("*").alias("_n"), F.min("_low").alias("component_id")).where("_n > 1").drop("_n")
    owner = salted(named, lows, ["root"], "fingerprint", how="left").select(F.col("fingerprint").alias("_print"), F.coalesce("component_id", "_low").alias("component_id"))
    joined = prints.join(owner, F.col("fingerprint") == F.col("_print"))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in others), "fingerprint", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest doc_id, a repeated row once."""
    row = F.xxhash64("doc_id", "text")
    groups = near_duplicates(documents.select("doc_id", "text", row.alias("_row")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    kept = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_print")).agg(F.min(order).alias("_kept"))
    kept = kept.select(F.col("_kept.doc_id").alias("_id"), F.col("_kept._row").alias("_hash"))
    rows = documents.withColumn("_row", row)
    # one shuffle of the texts, by the row's hash, serves the join and the removal of repeated rows
    same = F.coalesce(rows["doc_id"] == kept["_id"], rows["doc_id"].isNull() & kept["_id"].isNull())
    joined = rows.join(kept, (rows["_row"] == kept["_hash"]) & same, "left_semi")
    return joined.dropDuplicates(["_row", "doc_id"]).select(*documents.columns)
