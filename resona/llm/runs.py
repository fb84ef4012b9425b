"""Periodic runs of words, by longest common extensions on suffix trees.

A run is a stretch of consecutive words that has a smallest period q, is at least ``EXPONENT`` times
as long and at least ``LEAST`` words, and that no neighbouring word extends keeping the period.

Every run holds, at some place, the longest Lyndon word that starts there under one of the two
orders of the words (any order and its reverse), and that word's length is the period.  So the
longest Lyndon word at each place, under both orders, is a candidate: it ends where the next smaller
suffix starts.  How far its period goes on is the longest common extension of its start and its end:
to the right in the suffix tree of the words, to the left in that of the reversal.  Both trees are
built by Ukkonen's algorithm; an extension is the string depth of the lowest common ancestor of two
leaves, the minimum between them on an Euler tour of the tree, which block minima with a sparse table
over them give in constant time.  All candidates of a tree are extended at once.

Trees are built for those stretches of a text that can hold a run.  Within a run, from its second
period on, each ``GRAM`` words end where the same words ended at most q before; stretches of places
where that is so, long enough for some q between powers of two, are widened by a period, and nothing
else can hold a run.  So a text that does not repeat itself costs one sort of its grams.  Within a text,
words are told apart by 64-bit hashes.

Cases: a null text has no words; a text of any length is worked on whole, and a tree takes some
kilobyte for each word of its longest stretch; nulls in other columns, ties and repeated rows are
rows like any other; an empty table gives none; columns named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .frames import WORD, fold, table

#: A run's least length in periods and in words.
EXPONENT, LEAST = 4, 6
#: Words that must recur at a period's distance for a place to be looked at.
GRAM = 3
#: Entries of the tour that one block minimum covers.
BLOCK = 16


class Extensions:
    """The suffix tree of a text of positive integers: longest common extensions, and ranks of its suffixes."""

    def __init__(self, text: np.ndarray):
        self.letters = [*text.tolist(), 0]  # the end is a letter of its own, smaller than all
        self._build()
        self._tour()

    def _build(self) -> None:
        """Ukkonen's algorithm, with all edges in one dictionary by node and first letter; leaves come in the order of their suffixes."""
        t, n = self.letters, len(self.letters)
        base = max(t) + 1
        start, end, link, leaf, edges = [0], [0], [0], [-1], {}
        node = at = length = open_ = leaves = 0
        for i in range(n):
            letter, last = t[i], 0
            open_ += 1
            while open_:
                if not length:
                    at = i
                key = node * base + t[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i), end.append(n), link.append(0), leaf.append(leaves)
                    leaves += 1
                    if last:
                        link[last], last = node, 0
                else:
                    first = start[child]
                    size = end[child] - first
                    if length >= size:
                        node, at, length = child, at + size, length - size
                        continue
                    if t[first + length] == letter:
                        if last:
                            link[last] = node
                        length += 1
                        break
                    split = len(start)
                    edges[key] = split
                    start.append(first), end.append(first + length), link.append(0), leaf.append(-1)
                    edges[split * base + letter] = split + 1
                    start.append(i), end.append(n), link.append(0), leaf.append(leaves)
                    leaves += 1
                    start[child] = first + length
                    edges[split * base + t[first + length]] = child
                    if last:
                        link[last] = split
                    last = split
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length, at = length - 1, i - open_ + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.kids = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.bounds = np.searchsorted(keys[order] // base, np.arange(len(start) + 1))
        self.sizes = (np.array(end) - np.array(start)).tolist()
        self.leaf = leaf

    def _tour(self) -> None:
        kids, ends, sizes, leaf = self.kids.tolist(), self.bounds[1:].tolist(), self.sizes, self.leaf
        upto, depth, tour = self.bounds.tolist(), [0] * len(sizes), []
        first, ranks = [0] * len(self.letters), []
        stack = [0]
        while stack:
            node = stack[-1]
            if leaf[node] >= 0:
                first[leaf[node]] = len(tour)
                ranks.append(leaf[node])
                tour.append(depth[node])
                stack.pop()
                continue
            tour.append(depth[node])
            at = upto[node]
            if at < ends[node]:
                upto[node] = at + 1
                child = kids[at]
                depth[child] = depth[node] + sizes[child]
                stack.append(child)
            else:
                stack.pop()
        self.first, self.ranks = np.array(first), ranks
        minima = np.array(tour, np.int32)
        self.tour = np.concatenate([minima, np.full(-len(minima) % BLOCK, np.iinfo(np.int32).max, np.int32)]).reshape(-1, BLOCK)
        self.before = np.minimum.accumulate(self.tour, axis=1).reshape(-1)
        self.after = np.minimum.accumulate(self.tour[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [self.tour.min(axis=1)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(self.levels[0]):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))
        self.tour = self.tour.reshape(-1)

    def longest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at i and at j, two different ones, have in common at their start."""
        a, b = self.first[i], self.first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        out = np.minimum(self.after[a], self.before[b])
        low, high = a // BLOCK + 1, b // BLOCK
        inner = np.flatnonzero(low == high + 1)
        found = self.tour[a[inner]]
        for step in range(1, BLOCK):
            found = np.minimum(found, self.tour[np.minimum(a[inner] + step, b[inner])])
        out[inner] = found
        far = low < high
        level = np.zeros(len(a), np.int64)
        level[far] = np.frexp((high - low)[far].astype(float))[1] - 1
        for k in np.unique(level[far]).tolist():
            at = np.flatnonzero(far & (level == k))
            out[at] = np.minimum(out[at], np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k)]))
        return out

    def reverse_ranks(self) -> list[int]:
        """The suffixes in the order in which letters are reversed, but the end is still the smallest."""
        kids, bounds, leaf, letters = self.kids.tolist(), self.bounds.tolist(), self.leaf, self.letters
        size, out, stack, depth = len(letters), [], [0], self.sizes
        reach = {0: 0}
        while stack:
            node = stack.pop()
            if leaf[node] >= 0:
                out.append(leaf[node])
                continue
            lo, hi = bounds[node], bounds[node + 1]
            below = kids[lo:hi]
            deep = reach.pop(node)
            # the child that goes on with the end alone is a leaf, and comes first in either order
            ending = below[0] if leaf[below[0]] >= 0 and leaf[below[0]] + deep == size - 1 else None
            rest = below[1:] if ending is not None else below
            for child in rest:
                if leaf[child] < 0:
                    reach[child] = deep + depth[child]
            stack += rest
            if ending is not None:
                stack.append(ending)
        return out


def lyndon_ends(ranked: list[int], n: int) -> np.ndarray:
    """For each place, where the longest Lyndon word that starts there ends: at the next smaller suffix."""
    rank = [0] * (n + 1)
    for place, suffix in enumerate(ranked):
        rank[suffix] = place
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        mine = rank[i]
        while rank[stack[-1]] > mine:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends)


def runs_of(words: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of each run of a text of integers, by start, then period."""
    n = len(words)
    letters = np.unique(words, return_inverse=True)[1] + 1
    forward, backward = Extensions(letters), Extensions(letters[::-1])
    found = []
    for ranked in (forward.ranks, forward.reverse_ranks()):
        i = np.arange(n)
        j = lyndon_ends(ranked, n)
        period = j - i
        right = forward.longest(i, j)
        left = np.zeros(n, np.int64)
        left[1:] = backward.longest(n - i[1:], n - j[1:])
        length = left + period + right
        held = (length >= np.maximum(least, exponent * period)) & (length >= 2 * period)
        found.append(np.stack([i[held] - left[held], length[held], period[held]], axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(words: np.ndarray, rows: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """(start, end) of the stretches of words, apart and within a row, that hold all runs; words: hashes, rows: bounds of texts."""
    n = len(words)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    place = np.arange(n)
    whole = np.flatnonzero(place - rows[:-1][row] >= GRAM - 1)
    if not len(whole):
        return np.zeros((0, 2), np.int64)
    grams = K.mix(K.gram_hashes(words, whole - GRAM + 1, whole + 1) + row[whole].astype(np.uint64))
    order = np.argsort(grams, kind="stable")
    again = grams[order[1:]] == grams[order[:-1]]
    never = np.iinfo(np.int64).max
    distance = np.full(n, never)
    distance[whole[order[1:]][again]] = np.diff(whole[order])[again]
    found, most, longest = [np.zeros((0, 2), np.int64)], 1, int(np.diff(rows).max())
    while exponent * (q := most // 2 + 1) <= longest:
        need = max(1, max(least, exponent * q) - q - GRAM + 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], distance <= most, [False]]).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2]
        # a stretch of places does not cross rows: the first places of a row have no gram
        held = hi - lo >= need
        lo, hi = lo[held], hi[held]
        of = row[lo] if len(lo) else lo
        found.append(np.stack([np.maximum(rows[of], lo - most - GRAM), np.minimum(rows[of + 1], hi + 1)], axis=1))
        most *= 2
    found = np.concatenate(found)
    found = found[np.argsort(found[:, 0], kind="stable")]
    if not len(found):
        return found
    upto = np.maximum.accumulate(found[:, 1])
    opens = np.concatenate([[True], (found[1:, 0] >= upto[:-1]) | (row[found[1:, 0]] != row[found[:-1, 0]])])
    return np.stack([found[opens, 0], upto[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(found) - 1]])]], axis=1)


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(documents: DataFrame, text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """The other columns with n_words, runs by start and period, and collapsed: the text's words, joined by one space, without those that a run holds after its first period."""
    made = ("n_words", "runs", "collapsed")
    others = [c for c in documents.columns if c != text and c not in made]
    schema = T.StructType([*documents.select(*others).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, bounds = K.text_buffer(part.column(text))
        starts, ends, rows = K.word_bounds(raw, bounds)
        hashes = K.word_hashes(raw, starts, ends)
        found = [runs_of(hashes[a:b], exponent, least) + [a, 0, 0] for a, b in stretches(hashes, rows, exponent, least).tolist()]
        found = np.concatenate([np.zeros((0, 3), np.int64), *found])
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        held = np.searchsorted(found[:, 0], rows)
        base = np.repeat(rows[:-1], np.diff(held))
        out, at = K.joined(raw, starts[kept], ends[kept])
        cuts = at[np.concatenate([[0], np.cumsum(kept)])[rows]]
        data = out.tobytes()
        texts = [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        runs = pa.StructArray.from_arrays([pa.array(x) for x in (found[:, 0] - base, found[:, 1], found[:, 2])], names=["start", "length", "period"])
        columns = [pa.array(np.diff(rows)), pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), runs), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *columns], names=[*others, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                yield one(part)

    return documents.select(*others, text).mapInArrow(run, schema)


def with_planted(documents: DataFrame) -> DataFrame:
    """The documents, of which one in ten by the crc32 of its id has its last words replaced by repeats of their first."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8"))
    split = documents.withColumn("_words", F.when(fold("doc_id", 10) == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    split = split.withColumn("_n", F.size("_words").cast("long")).withColumn("_g", F.floor(h / 10))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    split = split.withColumn("_a", a.cast("int"))
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    head, cycle = F.slice("_words", F.lit(1), F.col("_a")), F.slice("_words", F.col("_a") + 1, p)
    tail = F.flatten(F.array_repeat(cycle, F.ceil((F.col("_n") - F.col("_a")) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(head, tail), F.lit(1), F.col("_n").cast("int")), " ")
    return split.withColumn("text", F.when(F.col("_n") > 0, planted).otherwise(F.col("text"))).drop("_words", "_n", "_g", "_a")


def greatest(runs: str | Column) -> Column:
    """The run with the greatest exact length / period, the first of equals."""
    none = F.lit(None).cast(RUN)
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    return F.aggregate(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(documents).withColumn("best", greatest("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )
