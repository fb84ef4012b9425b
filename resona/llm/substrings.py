"""Substring dedup: seed and extend on winnowed anchors.

A window is ``WINDOW`` consecutive words of a text.  A word is removed if a window that covers it has
a word sequence that also starts anywhere else, in any text.

The seed of a window is its anchor, the gram of ``GRAM`` words of least hash in it, the first of
equals; equal windows have equal anchors at equal places, and neighbouring windows mostly share one.
So only anchors are joined: those that occur once need no more work.  Extension to both sides goes
by the anchor's context, all words that any window with this anchor can have.  If the context occurs
again, so do all its windows.  Where it does not, but the anchor does, the repeat ends within the
context, and each of the windows there is looked up; one context of every kind takes part.  Adjacent
repeated windows then make up the maximal repeats.  Since a verdict belongs to a context and not to
a place, a text finds its verdicts by the contexts that it has.

Words, grams, contexts and windows are compared by hashes: contexts by 128 bits with their anchor's,
windows by 96.  Hot anchors are added up before they are shuffled, and the joins back are ones that
Spark can split.

Cases: a null text has no words; texts shorter than a window keep all; equal rows repeat each other;
a text that repeats itself loses both places; of grams with equal hashes in a window the first is its
anchor; a text of any length is worked on whole, in a slice of its own; other columns stay, and
clashing ones give way; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, stash, table

WINDOW, GRAM = 35, 8
#: A gram's rank is the high bits of its hash; the low ones make room for its position.
PLACE_BITS = 24


class Anchors:
    """The anchors of a slice of texts, with the windows that have them and their contexts."""

    def __init__(self, texts: pa.Array, window: int = WINDOW, gram: int = GRAM):
        raw, bounds = K.text_buffer(texts)
        self.raw, self.window = raw, window
        self.starts, self.ends, self.rows = K.word_bounds(raw, bounds)
        words = K.word_hashes(raw, self.starts, self.ends)
        self.words, n = words, len(words)
        none = np.zeros(0, np.int64)
        self.at = self.low = self.high = self.row = none
        self.seed = self.context = none.astype(np.uint64)
        if n < window:
            return
        grams = K.gram_hashes(words, np.arange(n - gram + 1), np.arange(gram, n + 1))
        first = self._least(grams, window - gram + 1)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        place = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        if not len(place):
            return
        anchor = first[place]
        opens = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (np.diff(place) != 1)))
        self.at, self.low = anchor[opens], place[opens]
        self.high = place[np.append(opens[1:] - 1, len(place) - 1)]
        self.row = row[self.at]
        self.seed = grams[self.at]
        left = np.maximum(self.rows[self.row], self.at - (window - gram))
        right = np.minimum(self.rows[self.row + 1], self.at + window)
        self.context = K.mix(K.gram_hashes(words, left, right) + (self.at - left).astype(np.uint64))

    @staticmethod
    def _least(grams: np.ndarray, width: int) -> np.ndarray:
        """For each run of ``width`` grams, where its least is, the first of equals."""
        rank = grams >> np.uint64(PLACE_BITS)
        if len(grams) >> PLACE_BITS:
            runs = np.lib.stride_tricks.sliding_window_view(rank, width)
            return np.concatenate([runs[i : i + (1 << 16)].argmin(axis=1) + np.arange(i, min(i + (1 << 16), len(runs))) for i in range(0, len(runs), 1 << 16)])
        key, span = rank << np.uint64(PLACE_BITS) | np.arange(len(rank), dtype=np.uint64), 1
        while 2 * span <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < width:
            key = np.minimum(key[: len(rank) - width + 1], key[width - span :])
        return (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor number and start of each window of the chosen anchors."""
        n = self.high[chosen] - self.low[chosen] + 1
        anchor = np.repeat(chosen, n)
        return anchor, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low[chosen], n)

    def kept(self, repeated: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The texts without the words that windows at these starts cover, and how many those are."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        text, at = K.joined(self.raw, self.starts, self.ends)
        whole, out = text.tobytes(), []
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[self.rows[1:]] - total[self.rows[:-1]]
        for i, (a, b) in enumerate(zip(self.rows[:-1].tolist(), self.rows[1:].tolist(), strict=True)):
            if not removed[i]:
                out.append(whole[at[a] : at[b] - 1] if b > a else b"")
                continue
            stay = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
            out.append(b" ".join(whole[at[a + s] : at[a + e] - 1] for s, e in zip(stay[::2].tolist(), stay[1::2].tolist(), strict=True)))
        return out, removed


def _find(rows: np.ndarray, values: np.ndarray, in_rows: np.ndarray, in_values: np.ndarray) -> np.ndarray:
    """For each (row, value) its position in the second list, or -1."""
    if not len(in_rows):
        return np.full(len(rows), -1)
    one, other = (K.mix(v ^ K.mix(r.astype(np.uint64) + np.uint64(1))) for r, v in ((rows, values), (in_rows, in_values)))
    order = np.argsort(other)
    at = order[np.minimum(np.searchsorted(other[order], one), len(order) - 1)]
    return np.where(other[at] == one, at, -1)


def _asked(part: pa.RecordBatch, column: str, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, context and a field of every item of a column of lists of structs."""
    lists = part.column(column)
    items, sizes = lists.flatten(), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), items.field("context").to_numpy().view(np.uint64), items.field(field).to_numpy(zero_copy_only=False)


def remove_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The other columns with n_words, n_removed and kept, the text without repeated passages."""
    names = [c for c in documents.columns if c not in ("n_words", "n_removed", "kept", "_key", "_asked", "_of")]
    rows = documents.select(*names, F.xxhash64(key, text).alias("_key"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                a = Anchors(part.column(text))
                order = np.lexsort((a.context, a.seed, a.row))
                row, seed, context = a.row[order], a.seed[order], a.context[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]) | (context[1:] != context[:-1]))[: len(row)])
                n = np.minimum(np.diff(np.append(first, len(row))), 2)
                keys = part.column("_key").take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([pa.array(seed[first].view(np.int64)), pa.array(context[first].view(np.int64)), keys, pa.array(n)], names=["seed", "context", "_of", "n"])

    found = rows.select("_key", text).mapInArrow(anchors, "seed long, context long, _of long, n long")
    # written first, so that the join below can split the anchors of a hot seed
    repeated = found.groupBy("seed").agg(F.sum("n").alias("n"), (F.min("context") != F.max("context")).alias("several"))
    repeated = cut(repeated.where("n > 1").select("seed", "several"))
    seeds = stash(found.join(repeated, "seed"))
    kinds = seeds.groupBy("seed", "context").agg(F.sum("n").alias("n"), F.min("_of").alias("_of"), F.max("several").alias("several"))
    whole = seeds.join(kinds.where("n > 1").select("seed", "context"), ["seed", "context"], "left_semi").select("_of", "context", F.lit(-1).alias("windows"))

    ends = kinds.where("several").select("_of", F.struct("context", (F.col("n") == 1).alias("alone")).alias("item"))
    asked = ends.groupBy("_of").agg(F.collect_list("item").alias("_asked"))  # as many as the text has anchors

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                a = Anchors(part.column(text))
                row, context, alone = _asked(part, "_asked", "alone")
                held = _find(row, context, a.row, a.context)
                alone, held = alone[held >= 0].astype(bool), held[held >= 0]
                anchor, start = a.windows(held)
                alone = np.repeat(alone, a.high[held] - a.low[held] + 1)
                one, two = (K.gram_hashes(a.words, start, start + WINDOW, second=s) for s in (False, True))
                keys = part.column("_key").take(pa.array(a.row[anchor]))
                columns = [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), keys, pa.array(a.context[anchor].view(np.int64)), pa.array((a.at[anchor] - start).astype(np.int32)), pa.array(alone)]
                yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "_of", "context", "offset", "alone"])

    # both joins below read one shuffle of the texts
    windows = rows.join(asked, rows["_key"] == asked["_of"]).drop("_of").mapInArrow(extend, "one long, two int, _of long, context long, offset int, alone boolean")
    again = windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    partly = windows.where("alone").join(again, ["one", "two"], "left_semi").groupBy("_of", "context").agg(F.expr("bit_or(shiftleft(1, offset))").alias("windows"))
    verdicts = whole.union(partly).groupBy("_of").agg(F.collect_list(F.struct("context", "windows")).alias("_asked"))
    schema = rows.drop("_key").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text):
                a = Anchors(part.column(text))
                row, context, masks = _asked(part, "_asked", "windows")
                at = _find(a.row, a.context, row, context)
                held = np.flatnonzero(at >= 0)
                anchor, start = a.windows(held)
                offset = a.at[anchor] - start
                hit = masks[at[anchor]].astype(np.int64) >> offset & 1 if len(anchor) else np.zeros(0, np.int64)
                kept, removed = a.kept(start[hit == 1])
                columns = [*(part.column(c) for c in names), pa.array(np.diff(a.rows)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.join(verdicts, rows["_key"] == verdicts["_of"], "left").drop("_of").mapInArrow(remove, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))
