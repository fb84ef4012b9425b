"""Near-duplicates by Jaccard similarity of word shingles, found with HyperMinHash.

A text's set is its distinct shingles, as 64-bit hashes.  Their top bits deal them to ``BUCKETS``
buckets, and of each bucket the smallest rest is kept in 16 bits, like a floating-point number: how
many zeros lead it, and the ``MANTISSA`` bits after its first one.  Two sets have the same register
where they have the same minimum, and sometimes by chance; only candidates come of that chance.

* Equal sets are one node, by two independent sums of their hashes.
* Bands of ``ROWS`` registers are keys.  Few shingles leave most registers empty, so sets of at most ``SMALL``
  have keys of their own: their smallest hashes, so many that two sets that link share one for certain.
  Keys that the same nodes share are one key.  Nodes that share a key are compared within it by all their
  registers: the share that agrees, less the number expected by chance at both sizes, estimates the
  similarity.  A pair below the threshold by more than ``MARGIN`` is not looked at again; the
  margin is six standard deviations of the estimate, and the bands miss a link at the threshold once in 10**8.
* Each key gives a spanning forest of its pairs with the best estimates, which is less than one pair a
  node, not all pairs.  Nodes that these pairs connect are a group, and every link lies within one.
* Links are confirmed on full sets, which meet once for each group: all numbers of common shingles at once,
  by products of matrices for shingles that many have, by pairs for the others.  A forest of the links
  is what a group gives.
* A key of over ``CHUNK`` nodes, or a group of as many or of over ``LARGE`` shingles, is cut into chunks, and each two
  chunks are work of their own.

Cases: a text without words, or null, is linked with nothing, not even its like; one of fewer words than
a shingle has one shingle; a component is named by its smallest non-null doc_id, null if it has none,
and a row is kept if that is its own (or both are null); repeated rows get the same values; a text of any
length is hashed whole, in a slice of its own; other columns stay, and clashing ones give way; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, lookup, salted, stash, table
from .simhash import components

SHINGLE = 3
#: Link from this many hundredths of the union on; the bands below are made for it.
PERCENT = 85
BUCKETS, MANTISSA = 256, 10
#: Registers of a band, and bands.
ROWS, BANDS = 5, 32
#: Shingles up to which a set has keys by its smallest hashes.
SMALL = 48
#: How far below the threshold an estimate may be of a pair that links.
MARGIN = 0.135
#: Nodes of a key or group, and shingles of a group, that are compared with each other in one piece of work.
CHUNK, LARGE = 1024, 1 << 20
#: Sets from which on a shingle counts by a product of matrices, and shingles of one product.
MANY, COLUMNS = 32, 2048


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order, and the bounds of each text's."""
    raw, bounds = K.text_buffer(texts)
    raw = K.lower_ascii(raw)
    starts, ends, rows = K.word_bounds(raw, bounds)
    words = K.word_hashes(raw, starts, ends)
    n_words = np.diff(rows)
    n = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(edges[-1]) + np.repeat(rows[:-1] - edges[:-1], n)
    hashes = K.mix(K.gram_hashes(words, first, np.minimum(first + shingle, rows[1:][row])) ^ np.minimum(n_words, shingle)[row].astype(np.uint64))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], np.searchsorted(row[fresh], np.arange(len(n) + 1))


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set its registers: 0 for an empty bucket, else 1 + leading zeros << MANTISSA + the bits after the first one."""
    out = np.zeros((len(bounds) - 1, BUCKETS), np.uint16)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    # hashes ascend within a set, so the first of a bucket is its smallest
    least = np.ones(len(row), bool)
    least[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    rest = ((hashes[least] << np.uint64(8)) >> np.uint64(16)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    bits = np.where(rest > 0, np.floor((2 * fraction - 1) * (1 << MANTISSA)), 0)
    out[row[least], bucket[least]] = 1 + ((48 - exponent) << MANTISSA) + bits.astype(np.int64)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many registers of two unrelated sets of n and m shingles are equal by chance, empty ones aside.

    The minimum of a bucket lies between 2**-(i+1) and 2**-i with the probability that no shingle is
    below and one is not above; there it has one of 2**MANTISSA values, about alike.
    """
    total = np.zeros(len(n))
    for i in range(48):
        low, high = 2.0 ** -(i + 1) / BUCKETS, 2.0**-i / BUCKETS
        total += (np.exp(-n * low) - np.exp(-n * high)) * (np.exp(-m * low) - np.exp(-m * high))
    return total * BUCKETS / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sets by their registers, row by row, corrected for collisions."""
    equal = ((a == b) & (a > 0)).sum(axis=1)
    either = ((a | b) > 0).sum(axis=1)
    return (equal - chance(n, m)) / np.maximum(either, 1)


def band_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node and band a 64-bit key of the band's registers, and whether any of them is set."""
    bands = np.ascontiguousarray(found[:, : ROWS * BANDS]).reshape(len(found), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(ROWS):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key, bands.any(axis=2)


def node_ids(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes of each set, none of an empty one: two independent sums over its hashes."""
    n = np.diff(bounds)
    sums = np.zeros((len(n), 2), np.uint64)
    held = np.flatnonzero(n)
    if len(held):
        sums[held] = np.stack([np.add.reduceat(K.mix(hashes ^ np.uint64(x)), bounds[held]) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)
    return [x.tobytes() if k else None for x, k in zip(sums, n.tolist(), strict=True)]


def prefix(n: int) -> int:
    """How many of a small set's smallest hashes are keys: two sets that link have one of them in common."""
    return n - -(-PERCENT * n // 100) + 1 if 0 < n <= SMALL else 0


def banded(n: np.ndarray) -> np.ndarray:
    """Whether a set of n shingles can link with one that is not small, so that its bands are keys."""
    return 100 * n > PERCENT * SMALL


def sketches(documents: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with node (16 bytes, null for an empty set), n_shingles, registers, and the smallest hashes of a small set."""
    made = ("node", "n_shingles", "registers", "smallest")
    others = [c for c in documents.columns if c != text and c not in made]
    schema = documents.select(*others).schema.add("node", "binary").add("n_shingles", "long").add("registers", "binary").add("smallest", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                hashes, bounds = shingle_sets(part.column(text))
                n = np.diff(bounds)
                nodes = node_ids(hashes, bounds)
                regs = [x.tobytes() for x in registers(hashes, bounds)]
                smallest = [hashes[a : a + prefix(k)].tobytes() for a, k in zip(bounds[:-1].tolist(), n.tolist(), strict=True)]
                columns = [pa.array(nodes, pa.binary()), pa.array(n), pa.array(regs, pa.binary()), pa.array(smallest, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], names=[*others, *made])

    return documents.select(*others, text).mapInArrow(run, schema)


def full_sets(documents: DataFrame, text: str = "text") -> DataFrame:
    """node and members, the shingle hashes in ascending order, of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                hashes, bounds = shingle_sets(part.column(text))
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(hashes, bounds), pa.binary()), pa.array(sets, pa.binary())], names=["node", "members"])

    return documents.select(text).mapInArrow(run, "node binary, members binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """A row (key, band, node) for each band of a node, and for each of the smallest hashes of a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, held = band_keys(_registers(part.column("registers")))
                row, band = np.nonzero(held & banded(part.column("n_shingles").to_numpy())[:, None])
                few = [np.frombuffer(x, np.uint64) for x in part.column("smallest").to_pylist()]
                sizes = np.array([len(x) for x in few])
                values = np.concatenate([keys[row, band], K.mix(np.concatenate(few) ^ np.uint64(0x94D049BB133111EB))])
                place = pa.array(np.concatenate([row, np.repeat(np.arange(len(few)), sizes)]))
                bands = np.concatenate([band, BANDS + np.zeros(sizes.sum(), np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bands), part.column("node").take(place)], names=["key", "band", "node"])

    return nodes.select("node", "n_shingles", "registers", "smallest").mapInArrow(run, "key long, band int, node binary")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """The rows of keyed() of keys with several nodes; of keys that have the same nodes, those of the first."""
    by = Window.partitionBy("key")
    one, other = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    held = keyed(nodes).withColumns({"n": F.count("*").over(by), "one": F.bit_xor(one).over(by), "other": F.bit_xor(other).over(by)}).where("n > 1")
    held = stash(held)
    first = held.groupBy("n", "one", "other").agg(F.min(F.struct("band", "key")).alias("first")).select(F.col("first.key").alias("key"))
    return held.join(first.distinct(), "key", "left_semi").select("key", "band", "node")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def forest(a: np.ndarray, b: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Which of the edges (a, b) among n places are a spanning forest of the greatest values (Boruvka)."""
    order = np.lexsort((b, a, -value))
    at, label, chosen = np.arange(len(order)), np.arange(n), []
    while True:
        x, y = label[a[order[at]]], label[b[order[at]]]
        open_ = x != y
        at, x, y = at[open_], x[open_], y[open_]
        if not len(at):
            return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)
        best = np.full(n, len(order))
        np.minimum.at(best, x, at)
        np.minimum.at(best, y, at)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        x, y = label[a[order[picked]]], label[b[order[picked]]]
        while (apart := x != y).any():
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(label, high, low)
            while (down := label[label]).tobytes() != label.tobytes():
                label = down
            x, y = label[x], label[y]


def compare(group: np.ndarray, found: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that are a spanning forest, of the best, of those in groups of equal, adjacent numbers whose estimate is at least ``least``."""
    n = len(group)
    at, ones, others, values = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for step in range(1, n):
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        b = at + step
        fits = 100 * np.minimum(sizes[at], sizes[b]) >= PERCENT * np.maximum(sizes[at], sizes[b])
        a, b = at[fits], b[fits]
        for i in range(0, len(a), 1 << 13):
            x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
            value = estimate(found[x], found[y], sizes[x], sizes[y])
            held = value >= least
            ones.append(x[held]), others.append(y[held]), values.append(value[held])
    a, b = np.concatenate(ones), np.concatenate(others)
    held = forest(a, b, np.concatenate(values), n)
    return a[held], b[held]


def in_chunks(rows: DataFrame, by: str, sizes: DataFrame, chunk: int) -> DataFrame:
    """The rows (by, node, ...) with i and j, two chunks of their key whose nodes meet; sizes: (by, n), the chunks it takes."""
    held = rows.join(sizes.select(by, F.ceil(F.col("n")).cast("int").alias("chunks")), by)
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    # with several chunks, a chunk's own pairs meet in the work of any two; so it needs none of its own
    pairs = F.when(F.col("chunks") > 1, F.filter(pairs, lambda p: p["i"] != p["j"])).otherwise(pairs)
    return held.withColumn("pair", F.explode(pairs)).select(*rows.columns, "pair.i", "pair.j")


def _whole(rows: DataFrame, by: str, schema: str, work, least: int) -> DataFrame:
    """work(batch, group numbers) on rows dealt by (by, i, j): whole groups, in order, of a few ``least`` rows together."""
    dealt = rows.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def numbers(part: pa.RecordBatch) -> np.ndarray:
            name = part.column(by)
            first = np.ones(part.num_rows, bool)
            i, j = (part.column(c).to_numpy() for c in ("i", "j"))
            changed = np.asarray(pc.not_equal(name.slice(1), name.slice(0, part.num_rows - 1)))
            first[1:] = changed | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            return np.cumsum(first) - 1

        for batch in batches:
            for at in range(0, batch.num_rows, least):
                part = pa.Table.from_batches([held, batch.slice(at, least)] if held else [batch.slice(at, least)]).combine_chunks().to_batches()[0]
                group = numbers(part)
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield work(part.slice(0, last), group[:last])
                held = part.slice(last)
        if held is not None and held.num_rows:
            yield work(held, numbers(held))

    return dealt.mapInArrow(run, schema)


def candidates(members: DataFrame, nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pairs (u, v), u below v, that connect the same nodes as all pairs of nodes that share a key and may link; members: key, node."""
    sizes = members.groupBy("key").agg((F.count("*") / chunk).alias("n"))
    rows = in_chunks(members.select("key", "node"), "key", sizes, chunk)
    full = rows.join(nodes.select("node", "n_shingles", "registers"), "node")
    least = PERCENT / 100 - MARGIN

    def work(part: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        a, b = compare(group, _registers(part.column("registers")), part.column("n_shingles").to_numpy(), least)
        return pa.RecordBatch.from_arrays([part.column("node").take(pa.array(x)) for x in (a, b)], names=["u", "v"])

    return _whole(full, "key", "u binary, v binary", work, 1 << 11).distinct()


def common(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, n): how many hashes two rows have in common, above the diagonal; a row has a hash once."""
    order = np.lexsort((row, hashes))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    size = np.diff(np.append(first, len(hashes)))
    of = np.repeat(np.arange(len(first)), size)
    out = np.zeros((n, n), np.float32)
    many = np.flatnonzero(size >= MANY)
    for a in range(0, len(many), COLUMNS):
        place = np.full(len(first), -1)
        place[many[a : a + COLUMNS]] = np.arange(len(many[a : a + COLUMNS]))
        held = place[of] >= 0
        there = np.zeros((n, min(COLUMNS, len(many) - a)), np.float32)
        there[row[held], place[of[held]]] = 1
        out += there @ there.T
    few = np.flatnonzero((size < MANY)[of])
    for step in range(1, MANY):
        few = few[few + step < len(of)]
        few = few[of[few] == of[few + step]]
        if not len(few):
            break
        np.add.at(out, (row[few], row[few + step]), 1)
    return np.triu(out, 1)


def confirmed(sets: DataFrame, chunk: int = CHUNK, large: int = LARGE) -> DataFrame:
    """Links (u, v) that connect the same nodes as all links within each group; sets: group, node, n_shingles, members."""
    work_of = F.greatest(F.count("*") / chunk, F.sum("n_shingles") / large)
    rows = in_chunks(sets, "group", sets.groupBy("group").agg(work_of.alias("n")), chunk)

    def work(part: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        n = part.column("n_shingles").to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        hashes = np.frombuffer(b"".join(part.column("members").to_pylist()), np.uint64)
        # groups that are worked on together have no hash in common
        shared = common(K.mix(hashes + K.mix(group.astype(np.uint64) + np.uint64(1))[row]), row, len(n))
        a, b = np.nonzero(shared)
        both = shared[a, b].astype(np.int64)
        held = 100 * both >= PERCENT * (n[a] + n[b] - both)
        a, b = a[held], b[held]
        tree = forest(a, b, np.zeros(len(a)), len(n))
        return pa.RecordBatch.from_arrays([part.column("node").take(pa.array(x[tree])) for x in (a, b)], names=["u", "v"])

    return _whole(rows, "group", "u binary, v binary", work, 1 << 9).distinct()


def near_duplicates(documents: DataFrame, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """The other columns with n_shingles, component_id and kept."""
    others = [c for c in documents.columns if c not in (text, "n_shingles", "component_id", "kept")]
    # the columns that stay are packed away, so that none clashes with those of the work
    source = documents.select(F.struct(*others).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows = stash(sketches(source))
    # of equal sets, one text stands for all
    named = rows.where("node is not null")
    nodes = stash(named.groupBy("node").agg(F.min("id").alias("low"), F.min(F.struct("id", "hash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("smallest").alias("smallest")))
    members = stash(shared_keys(nodes))

    pairs = cut(candidates(members, nodes, chunk))
    joined = components(pairs)
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    asked = asked.join(joined, "node", "left").select(F.col("node").alias("asked"), F.coalesce("root", "node").alias("group"))
    wanted = cut(lookup(nodes.select("node", "n_shingles", F.col("first.id").alias("first"), F.col("first.hash").alias("wanted")), asked, F.col("node") == F.col("asked")).drop("asked"))
    chosen = lookup(source.select("id", "text", "hash"), wanted.select("first", "wanted"), (F.col("hash") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    sets = full_sets(chosen.select("text")).dropDuplicates(["node"])
    roots = components(confirmed(stash(wanted.select("group", "node", "n_shingles").join(sets, "node")), chunk))

    owned = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    # a component may hold a large share of all nodes: they are added up before the shuffle, and the way back is salted
    lows = owned.groupBy("root").agg(F.count("*").alias("n"), F.min("low").alias("least")).where("n > 1").drop("n")
    owner = salted(owned, lows, ["root"], "node", how="left").select("node", F.coalesce("least", "low").alias("owner"))
    joined = salted(rows.select("row", "id", "node", "n_shingles"), owner, ["node"], "id", how="left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("owner"))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in others), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(documents).select("doc_id", "n_shingles", "component_id", "kept")
