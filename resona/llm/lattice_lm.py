"""Language-model scoring over the lattice of subword segmentations.

The pieces are those of an existing subword vocabulary.  Its scores are ranks, not logarithms of
probabilities, so a piece of rank k is given the share 1 / (k + 2) of all (``vocabulary_shares``).
These shares alone weight the segmentations of ``vocab_score``.  For ``score`` they are the prior: a
piece's weight begins as how often it occurs where the vocabulary's own rule splits the training
words, added to the prior; then ``ROUNDS`` rounds of expectation maximisation over all training words
replace the counts by expected ones.  The end of a text is one more outcome.  A text's probability is
the sum over all its segmentations into pieces.  Pieces do not cross words, so that sum is a product over words,
and the forward recursion over a word's lattice, in logarithms, runs once for each distinct word of
all the texts.  Any byte may also be its byte piece, so no text has probability zero.

Beside it stands the base: smoothed counts of whole words in the training texts.

Words are counted over all texts.  Each task adds up what it can before the shuffle; a text keeps
the words that are among the ``COMMON`` most frequent, which every task knows, and only the others
travel to the table of words and back, so no key is hot.

Cases: a null or empty text is the end alone; a null doc_id hashes as an empty one; repeated rows
are texts of their own; with no training rows all counts are 0; words of equal counts are both common
or both not; a text or word of any length is scored whole; columns other than the two named are not
read, so their names cannot clash; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import kernels as K
from .frames import cut, fold, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Words that every task knows at most, and distinct words that a task holds before it passes them on.
COMMON, HELD = 100_000, 200_000
ROUNDS = 3
#: All pieces' prior weight together, in pieces.
PRIOR = 1000.0
SPACE = "▁".encode()


def words_of(text: str | None) -> list[bytes]:
    """The words, with A-Z lower-cased; bytes.split() knows the same six separators and no other."""
    return (text or "").encode().lower().split()


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_bytes(path: str) -> list[bytes | None]:
    """The bytes of each piece; None for control pieces."""
    model = processor(path)
    out: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(None if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.encode())
    return out


class Lattice:
    """The segmentations of many words at once.

    Every place before, between and after the bytes of a word is a node, and every piece found in it
    an edge.  Edges are sorted by where they end in their word, so the recursion takes all words one
    place further at a time.
    """

    def __init__(self, log_weight: dict[bytes, float]):
        raw = np.frombuffer(b"".join(log_weight), np.uint8)
        ends = np.cumsum([len(p) for p in log_weight])
        hashes = K.word_hashes(raw, ends - [len(p) for p in log_weight], ends)
        order = np.argsort(hashes)
        self.pieces = [p for _, p in sorted(zip(hashes.tolist(), log_weight, strict=True))]
        self.weight = np.array([log_weight[p] for p in self.pieces])
        self.hashes, self.longest = hashes[order], max(map(len, log_weight))
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Piece, first and last node and word of each edge, in order, and each word's last node."""
        raw = np.frombuffer(b"".join(SPACE + w for w in words), np.uint8)
        sizes = np.array([len(w) + len(SPACE) for w in words])
        stop = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        found, place, left = [], np.arange(len(raw)), stop[word] - np.arange(len(raw))
        for size in range(1, min(self.longest, int(sizes.max())) + 1):
            place = place[left[place] >= size]
            hashes = K.word_hashes(raw, place, place + size)
            held = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[held]), len(self.hashes) - 1)
            true = self.hashes[at] == hashes[held]
            found.append((at[true], place[held[true]], np.full(int(true.sum()), size)))
        piece, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
        of = word[start]
        to = start + size - (stop - sizes)[of]
        order = np.argsort(to * len(words) + of, kind="stable")
        piece, start, size, of, to = piece[order], start[order], size[order], of[order], to[order]
        return piece, start + of, start + size + of, of, to, stop + np.arange(len(words))

    def _forward(self, edges: tuple[np.ndarray, ...], weight: np.ndarray) -> tuple[np.ndarray, ...]:
        piece, first, last, of, to, final = edges
        reach = np.full(int(final[-1]) + 1, -np.inf)
        reach[np.concatenate([[0], final[:-1] + 1])] = 0.0
        through = np.empty(len(piece))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            through[a:b] = reach[first[a:b]] + weight[piece[a:b]]
            opens = np.flatnonzero(np.append(True, of[a + 1 : b] != of[a : b - 1]))
            reach[last[a:b][opens]] = np.logaddexp.reduceat(through[a:b], opens)
        return piece, first, last, of, cuts, through, reach, final

    def log_probabilities(self, words: list[bytes], *others: np.ndarray) -> np.ndarray:
        """Natural logarithms of the sums, over all segmentations, of the products of the pieces' weights; a row more for each of the other weights."""
        if not words:
            return np.zeros((1 + len(others), 0)) if others else np.zeros(0)
        edges, found = self._edges(words), []
        for weight in (self.weight, *others):
            *_, reach, final = self._forward(edges, weight)
            found.append(reach[final])
        return np.stack(found) if others else found[0]

    def expect(self, words: list[bytes], times: list[int]) -> np.ndarray:
        """How often each piece is expected in the words, times over."""
        if not words:
            return np.zeros(len(self.pieces))
        piece, first, last, of, cuts, through, reach, final = self._forward(self._edges(words), self.weight)
        rest = np.zeros(len(reach))  # share of a word's whole that passes a node
        rest[final] = 1.0
        share = np.exp(through - reach[last])
        for a, b in zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True):
            share[a:b] *= rest[last[a:b]]
            rest[first[a:b]] += share[a:b]  # edges that end at one place begin at different ones
        return np.bincount(piece, share * np.array(times, float)[of], len(self.pieces))


def word_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return K.slices(batch, "word", 1 << 17)


def count_words(documents: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, c): every distinct word of every text, with its count in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for part in K.slices(batch, text):
                for words, learn in zip(part.column(text).to_pylist(), part.column("_train").to_pylist(), strict=True):
                    if learn:
                        held.update(words_of(words))
                    else:
                        for word in words_of(words):
                            held.setdefault(word, 0)
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return documents.select(text, train.alias("_train")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary_shares(vocabulary: str = VOCABULARY) -> dict[bytes, float]:
    """Each piece's share by the rank of its score, greatest first; together they are 1."""
    model, pieces = processor(vocabulary), piece_bytes(vocabulary)
    scores = {i: model.get_score(i) for i, p in enumerate(pieces) if p is not None}
    harmonic = sum(1 / (k + 2) for k in range(len(scores)))
    shares: dict[bytes, float] = {}
    for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))):
        shares[pieces[i]] = shares.get(pieces[i], 0.0) + 1 / (k + 2) / harmonic
    return shares


def piece_weights(words: DataFrame, n_texts: int, vocabulary: str, rounds: int = ROUNDS) -> tuple[dict[bytes, float], float]:
    """Natural logarithms of the pieces' weights and of the end's."""
    pieces = piece_bytes(vocabulary)
    prior = {p: PRIOR * share for p, share in vocabulary_shares(vocabulary).items()}
    end = n_texts + 0.5
    train = words.where("c > 0")

    def weights(add_up) -> dict[bytes, float]:
        """The weights under what add_up(words, counts) makes of the training words, a row for each piece and task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter[bytes] = Counter()
            for batch in batches:
                for part in word_slices(batch):
                    for piece, n in add_up(part.column("word").to_pylist(), part.column("c").to_pylist()):
                        counts[piece] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.float64())], names=["piece", "n"])

        counts = {bytes(p): n for p, n in train.mapInArrow(run, "piece binary, n double").groupBy("piece").agg(F.sum("n")).collect()}
        total = sum(prior.values()) + sum(counts.values()) + end
        return {p: math.log((w + counts.get(p, 0.0)) / total) for p, w in prior.items()} | {b"": math.log(end / total)}

    def split(held: list[str], times: list[int]) -> Iterator[tuple[bytes, float]]:
        for ids, k in zip(processor(vocabulary).encode(held, num_threads=1), times, strict=True):
            for i in ids:
                if pieces[i] is not None:
                    yield pieces[i], float(k)

    found = weights(split)
    for _ in range(rounds):
        lattice = Lattice({p: w for p, w in found.items() if p})

        def expected(held: list[str], times: list[int], lattice: Lattice = lattice) -> Iterator[tuple[bytes, float]]:
            counts = lattice.expect([w.encode() for w in held], times)
            for i in np.flatnonzero(counts).tolist():
                yield lattice.pieces[i], float(counts[i])

        found = weights(expected)
    return found, found.pop(b"")


def score(documents: DataFrame, held_out: Column, vocabulary: str = VOCABULARY, common: int = COMMON, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, vocab_score) of every row."""
    rows = documents.select(F.col(key), held_out.alias("held_out"), F.col(text).alias("text"))
    words = cut(count_words(rows, ~F.col("held_out")))
    n_words, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_texts = rows.where(~F.col("held_out")).count()
    tokens, kinds = n_words + n_texts, n_kinds + (n_texts > 0)
    weight, end = piece_weights(words, n_texts, vocabulary)
    lattice = Lattice(weight)
    # the vocabulary's weights leave the end the share that it has of the training tokens
    ends = (n_texts + 0.5) / (tokens + 1)
    by_rank = vocabulary_shares(vocabulary)
    plain, plain_end = np.log(np.array([by_rank[p] for p in lattice.pieces])) + math.log(1 - ends), math.log(ends)
    per_token = math.log10(tokens + 0.5 * (kinds + 1))
    log10 = math.log(10)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in word_slices(batch):
                scores = lattice.log_probabilities([w.encode() for w in part.column("word").to_pylist()], plain) / log10
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("c"), *map(pa.array, scores)], names=["word", "c", "lp", "lv"])

    scored = words.mapInArrow(forward, "word string, c long, lp double, lv double")
    # the greatest counts, from a histogram of their logarithms: at most `common` rows for every task to hold
    step = F.floor(F.log("c") * 16)
    least, held = None, 0
    for at, n in sorted(words.where("c > 0").groupBy(step.alias("at")).count().collect(), reverse=True):
        held += n
        if held > common:
            break
        least = at
    top = words.where(F.lit(False) if least is None else (F.col("c") > 0) & (step >= least))
    known = {w.encode(): (c, math.log10(c + 0.5), lp, lv) for w, c, lp, lv in top.mapInArrow(forward, "word string, c long, lp double, lv double").collect()}
    shared = documents.sparkSession.sparkContext.broadcast(known)
    names = [key, "held_out", "uid", "word", "n", "n_tokens", "n_known", "base", "lp_sum", "lv_sum"]
    schema = StructType([StructField(f.name, f.dataType) for f in rows.select(key, "held_out").schema]).add("uid", "long").add("word", "string").add("n", "long").add("n_tokens", "long").add("n_known", "long").add("base", "double").add("lp_sum", "double").add("lv_sum", "double")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text, under a word that no text has, and one of each of its less common words."""
        listed, uid = shared.value, (TaskContext.get().partitionId() << 33) - 1
        end_base, end_known = math.log10(n_texts + 0.5), int(n_texts > 0)
        for batch in batches:
            for part in K.slices(batch):
                uids, word, n, row, heads = [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    uid += 1
                    held = words_of(t)
                    n_known, base, lp, lv = end_known, end_base, end / log10, plain_end / log10
                    for w, k in Counter(held).items():
                        found = listed.get(w)
                        if found is None:
                            uids.append(uid)
                            word.append(w)
                            n.append(k)
                            row.append(None)
                        else:
                            n_known += k
                            base += k * found[1]
                            lp += k * found[2]
                            lv += k * found[3]
                    uids.append(uid)
                    word.append(b" %d" % uid)
                    n.append(0)
                    row.append(i)
                    heads.append((len(held) + 1, n_known, base, lp, lv))
                at = pa.array(row, pa.int64())
                fields = [pa.array(x).take(at) for x in zip(*heads, strict=True)]
                columns = [part.column(key).take(at), part.column("held_out").take(at), pa.array(uids, pa.int64()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), *fields]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = rows.mapInArrow(look, schema)
    joined = parts.join(scored, "word", "left")
    c = F.coalesce("c", F.lit(0))
    whole = joined.groupBy("uid").agg(
        F.max(key).alias(key),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(F.when(F.col("n") > 0, F.col("n") * F.log10(c + 0.5)).otherwise(0.0))).alias("base"),
        (F.max("lp_sum") + F.sum(F.coalesce(F.col("n") * F.col("lp"), F.lit(0.0)))).alias("score"),
        (F.max("lv_sum") + F.sum(F.coalesce(F.col("n") * F.col("lv"), F.lit(0.0)))).alias("vocab_score"),
    )
    return whole.select(key, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * per_token).alias("base_score"), "score", "vocab_score")


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 5) == 1)
