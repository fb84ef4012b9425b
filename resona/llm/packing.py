"""Packing token sequences as a cutting-stock problem.

A document's ids, with one id 0 after them, are cut into pieces of ``CAPACITY``, then one of a
multiple of ``GRAIN``, then what is left.  The histogram of these few lengths is all that the
driver sees.  A linear program covers it with patterns of lengths that fit a sequence; new patterns come from a
knapsack dynamic program under the program's prices, until they can improve it by less than
``GAP``.  Whole parts of the solution are taken as they are, and what rounding leaves is packed
best-fit decreasing.  Pieces are ranked by length, and a piece's rank gives its pattern, sequence
and offset.  Since a sequence whose length is a power of two is not padded, such a pattern costs
its length and any other the capacity, and each costs ``SEQUENCE_COST`` besides.

The ids are those of the tokenizers library; tiktoken makes the same ones from the same vocabulary
and is faster on single words (a test compares the two on whole texts).

Cases: a null or empty text is the id 0 alone; repeated rows are packed each; ties in rank are
between equal pieces; documents of any length are cut; columns other than the two named are not
read, so their names cannot clash; an empty table gives none.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, ranked, table

CAPACITY, GRAIN = 1024, 32
#: The vocabulary as ranks, its pre-token pattern, and its one special token (fixed values).
VOCABULARY, SPECIAL = public_tokenizers.path("byte_bpe_50k.tiktoken"), {"<|endoftext|>": 50256}
#: What a sequence costs in the linear program besides its tokens and padding.
SEQUENCE_COST = 16
#: Stop when the program is proven to be within this share of its optimum.
GAP = 0.001
#: Words whose ids a worker keeps; the others are encoded again in each slice.
KEPT_WORDS = 250_000


class WordEncoder:
    """Ids of whole texts, put together from the ids of their words.

    A single space between two other characters always begins a new pre-token, so the parts
    around it can be encoded apart.  A text with any other white space next to a space, or a
    space at an end, is encoded as a whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.codec = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.kept: dict[str, bytes | None] = {}

    def _encode(self, text: str) -> bytes:
        plain = not any(name in text for name in SPECIAL)
        ids = self.codec.encode_ordinary(text) if plain else self.codec.encode(text, allowed_special="all")
        return array("I", ids).tobytes()

    def _word(self, part: str) -> bytes | None:
        """Ids of a part of a text; one that begins with a carriage return follows no space; None: the text must be encoded whole."""
        if part == "\n":
            return self._encode(part)
        body = part.removeprefix("\r")
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return self._encode(body if part[0] == "\r" else " " + body)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "\r" in text:
            return self._encode(text)
        # a line break between two other characters is a pre-token of its own
        parts = ("\r" + text.replace("\n", " \n \r")).split(" ")
        try:
            return b"".join(map(self.kept.__getitem__, parts))
        except (KeyError, TypeError):
            pass
        ids = []
        for part in parts:
            if part in self.kept:
                held = self.kept[part]
            else:
                held = self._word(part) if part else None
                if len(self.kept) < KEPT_WORDS:
                    self.kept[part] = held
            if held is None:
                return self._encode(text)
            ids.append(held)
        return b"".join(ids)


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, grain: int = GRAIN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of every piece of every document."""
    schema = documents.select(key).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for part in K.slices(batch, text, rows=4096):
                cuts = []
                for i, t in enumerate(part.column(text).to_pylist()):
                    ids = encode.encode(t or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    ends = sorted({*range(0, n, capacity), n // capacity * capacity, n // grain * grain, n})
                    cuts += [(i, a, b - a, crc32(ids[4 * a : 4 * b]), n) for a, b in pairwise(ends)]
                row, *columns = (pa.array(np.array(c, np.int64)) for c in zip(*cuts, strict=True))
                columns = [part.column(key).take(row), *columns]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(key, text).mapInArrow(run, schema)


def _cost(fill: np.ndarray, capacity: int) -> np.ndarray:
    return np.where(fill & (fill - 1) == 0, fill, capacity) + SEQUENCE_COST


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fill up to the capacity, the best worth of lengths that add up to it, and the length put last (-1: none)."""
    worth, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    worth[0] = 0.0
    for fill in range(1, capacity + 1):
        n = np.searchsorted(lengths, fill, side="right")
        if n:
            values = worth[fill - lengths[:n]] + prices[:n]
            best = values.argmax()
            if values[best] > -np.inf:
                worth[fill], last[fill] = values[best], best
    return worth, last


def solve(demand: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, rounds: int = 500) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often) with how many sequences take each, covering the demand exactly."""
    lengths = np.array(sorted(demand), np.int64)
    if not len(lengths):
        return []
    need = np.array([demand[x] for x in lengths.tolist()], float)
    m = len(lengths)
    fits = capacity // lengths
    columns = np.diag(fits).astype(np.int64)
    cost = _cost(fits * lengths, capacity).astype(float)
    inverse, amount = np.diag(1.0 / fits), need / fits
    for _ in range(rounds):
        prices = cost @ inverse
        worth, last = _knapsack(lengths, prices, capacity)
        fill = np.arange(capacity + 1)
        gain = worth - _cost(fill, capacity)
        gain[0] = -np.inf
        if (worth[1:] / _cost(fill, capacity)[1:]).max() <= 1 + gap:
            break
        for f in np.argsort(-gain, kind="stable")[:24]:
            if gain[f] <= 1e-7 * capacity:
                break
            column, at = np.zeros(m, np.int64), f
            while at:
                column[last[at]] += 1
                at -= lengths[last[at]]
            c = float(_cost(np.array([f]), capacity)[0])
            if prices @ column - c <= 1e-7 * capacity:
                continue
            direction = inverse @ column
            up = direction > 1e-9
            ratio = np.full(m, np.inf)
            ratio[up] = amount[up] / direction[up]
            out = int(ratio.argmin())
            step = max(ratio[out], 0.0)
            amount -= step * direction
            amount[out] = step
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
            columns[:, out], cost[out] = column, c
            prices = cost @ inverse
    counts = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    rest = need.astype(np.int64) - columns @ counts
    while (rest < 0).any():  # only if the floor's tolerance took one too many
        short = int(np.flatnonzero(rest < 0)[0])
        j = int(np.flatnonzero((columns[short] > 0) & (counts > 0))[0])
        counts[j] -= 1
        rest += columns[:, j]
    plan = [({int(lengths[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}, int(counts[j])) for j in np.flatnonzero(counts)]
    return plan + _best_fit(dict(zip(lengths.tolist(), rest.tolist(), strict=True)), capacity)


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            left = next((r for r in range(length, capacity) if room[r]), None)
            held = room[left].pop() if left is not None else []
            held.append(length)
            room[(capacity if left is None else left) - length].append(held)
    found: dict[tuple[int, ...], int] = {}
    for held in (tuple(x) for r in room for x in r):
        found[held] = found.get(held, 0) + 1
    return [({x: p.count(x) for x in dict.fromkeys(p)}, n) for p, n in found.items()]


def pack(documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, grain: int = GRAIN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = cut(pieces(documents, vocabulary, capacity, grain, text, key))
    histogram = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    full = histogram.pop(capacity, 0)
    plan = solve(histogram, capacity) + ([({capacity: 1}, full)] if full else [])
    entries, sequence, taken = [], 0, dict.fromkeys([*histogram, capacity], 0)
    for pattern, count in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            entries.append((length, taken[length], pattern[length], sequence, offset))
            taken[length] += count * pattern[length]
            offset += length * pattern[length]
        sequence += count
    entries.sort()
    before = dict(zip(sorted(taken), np.cumsum([0, *(taken[x] for x in sorted(taken))]).tolist(), strict=False))
    length_, rank_, times, first, base = (np.array(x, np.int64) for x in (zip(*entries, strict=True) if entries else ((),) * 5))
    opens = rank_ + np.array([before[x] for x in length_.tolist()], np.int64)
    order = ranked(found, [F.col("length"), F.col(key), F.col("start"), F.col("ids_crc32")], "_rank")
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    schema = found.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(opens, rank, side="right") - 1
            local = rank - opens[at]
            offset = base[at] + local % times[at] * length_[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(first[at] + local // times[at]), pa.array(offset)], names=schema.names)

    return order.select(*names, "_rank").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
