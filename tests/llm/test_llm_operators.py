"""The first ten operators against brute force, on small tables with the awkward cases in them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from resona.llm import frames, kernels, language_id, lattice_lm, media, mixing, packing, registry, simhash, substrings, topk_search, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def make(seed=0, n=60):
    """Texts with copies, shared passages, nulls, blanks, odd white space and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, near = text(60), text(120)
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 80))
        if i % 5 == 0:
            t = t + "\n" + passage + "  " + text(10)
        elif i % 7 == 0:
            w = near.split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n ", "de", "b", 4), (n + 3, "Ünïcode\x1cß \xa0wörd…", "de", "b", 5), (n + 4, text(6000), "en", "a", 1)]
    rows += [rows[3], rows[3], (n + 5, rows[5][1], "en", "a", 2), (n + 6, "x " * 400, "en", "a", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The table, with columns that clash with what operators add."""
    held = spark.createDataFrame(make(), DOCS)
    return held.withColumns({c: F.lit("own") for c in ("size", "score", "fingerprint", "component_id", "kept", "media", "word", "toxic", "lang_pred", "_key", "url", "length")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(rows):
    return {r[0]: r for r in rows}


def test_word_bounds_are_those_of_the_pattern():
    texts = [r[1] for r in make()]
    raw, bounds = kernels.text_buffer(pa.array(texts))
    starts, ends, at = kernels.word_bounds(raw, bounds)
    for i, t in enumerate(texts):
        assert [raw[a:b].tobytes() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)] == words(t)


@pytest.mark.parametrize("size", [0, 1, 3, 4, 7, 8, 15, 31, 32, 33, 63, 64, 100, 1500])
def test_xxh64_equals_the_library(size):
    data = np.random.default_rng(size).integers(0, 256, 40 + size).astype(np.uint8)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    starts = np.arange(40)
    got = kernels.xxh64(raw, starts, starts + size)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s : s + size].tobytes(), 42) for s in starts]


# op1


def test_mix(docs, spark):
    got = mixing.mix(docs).select("doc_id", "size", "source", "source_size", "target", "rate", "copies").collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1, 5], strict=False))
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    for r in got:
        assert r.size == len(words(table(make())[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source]) and math.floor(r.rate) <= r.copies <= math.ceil(r.rate) <= 3
    emitted = Counter(r.doc_id for r in mixing.emit(mixing.mix(docs), ["doc_id"]).collect())
    assert emitted == +Counter({k: sum(r.copies for r in got if r.doc_id == k) for k in {r.doc_id for r in got}})


def test_mix_of_many_sources(docs, monkeypatch):
    """Above the rows that may be broadcast the join is salted, with the same result."""
    columns = ("doc_id", "size", "source", "source_size", "target", "copies")
    few = sorted(map(repr, mixing.mix(docs).select(*columns).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(repr, mixing.mix(docs).select(*columns).collect())) == few


def test_ranks_and_lookups_above_the_bound(spark, monkeypatch):
    held = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 100).alias("k"), "id")
    got = [r.id for r in frames.ranked(held, [F.col("k"), F.col("id")], "at").orderBy("at").collect()]
    assert got == [r.id for r in held.orderBy("k", "id").collect()]
    right = spark.range(100).select(F.col("id").alias("_k"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    joined = lambda: frames.lookup(held, right, F.col("k") == F.col("_k"))
    assert "broadcast" in plan(joined()) and joined().count() == 500
    monkeypatch.setattr(frames, "BROADCAST_ROWS", 50)
    assert "broadcast" not in plan(joined()) and joined().count() == 500


def test_mix_draws_meet_the_target(spark):
    held = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    got = mixing.mix(held).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.1 for r in got) and abs(sum(r.target for r in got) - 12000) < 1e-6


# op2


def without_repeats(texts, window=35):
    count, held = Counter(), [words(t) for t in texts]
    for w in held:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in held:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(docs):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(docs).collect())
    expected = sorted((r[0], *x) for r, x in zip(make(), without_repeats([r[1] for r in make()]), strict=True))
    assert got == expected and sum(x[2] for x in got) > 500


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed):
    """Texts over two words repeat in every way."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") * rng.choice((1, 1, 1, 40)) for _ in range(rng.randint(30, 60))) for _ in range(30)]
    texts = [t + " " + texts[0][: rng.randint(0, 200)] for t in texts] + [" ".join("abc"[i % 3] for i in range(90)), " ".join(["a"] * 300)]
    held = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.kept.encode()) for r in substrings.remove_repeats(held).collect())
    assert got == [(i, x[1], x[2]) for i, x in enumerate(without_repeats(texts))]


def test_a_long_slice_takes_the_same_anchors():
    grams = kernels.mix(np.arange(5000, dtype=np.uint64))
    short = substrings.Anchors._least(grams, 28)
    runs = np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(substrings.PLACE_BITS), 28)
    assert (short == runs.argmin(axis=1) + np.arange(len(runs))).all()


# op3


def test_toxicity(spark):
    rng = random.Random(1)
    common = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        t = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(["idiot,", "SCUM!!", "moron"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    held = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string").withColumn("toxic", F.lit(1))
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(held, truth.where("doc_id % 4 != 0"))
    got = {r.doc_id: r for r in toxicity.score(held, model).collect()}
    held_out = [(k, x) for k, x in labels if k % 4 == 0]
    assert np.mean([got[k].predicted == x for k, x in held_out]) > 0.97
    assert got[1000].score == got[1001].score < 0.3 and all(0 <= r.score <= 1 for r in got.values())


def test_factorization_machine_learns_pairs():
    """Neither feature alone tells, but both together do."""
    x = [[], [0], [1], [0, 1]] * 60
    labels = np.array([0, 0, 0, 1] * 60, float)
    rows, ids = np.repeat(np.arange(len(x)), [len(i) for i in x]), np.concatenate([np.array(i, np.int64) for i in x])
    model = toxicity._learn(rows, ids, labels, np.array([1, 2], np.uint64), 4)
    assert ((model.score(rows, ids, len(x)) > 0.5) == labels).all()
    flipped = toxicity._learn(rows, ids, np.array([0, 1, 1, 0] * 60, float), np.array([1, 2], np.uint64), 4)
    assert ((flipped.score(rows, ids, len(x)) > 0.5) == np.array([0, 1, 1, 0] * 60)).all()


def labelled_texts(kind, n=4000):
    """Texts whose label no sum of single words tells: one of two words, or an insult with the mention of a group (or a slur)."""
    rng = random.Random(5)
    common = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        t = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        if kind == "either":
            one, two = rng.random() < 0.5, rng.random() < 0.5
            t += ["alphaword"] * one + ["betaword"] * two
            toxic = one != two
        else:
            group, slur, insult = rng.random() < 0.6, rng.random() < 0.1, rng.random() < 0.28
            t += ["groupies"] * group + ["slurring"] * slur + ["insulting"] * insult
            toxic = slur or (insult and group)
        rng.shuffle(t)
        rows.append((i, " ".join(t), int(toxic)))
    return rows


@pytest.mark.parametrize("kind", ["either", "insult"])
def test_toxicity_learns_pairs_from_texts(spark, kind):
    rows = labelled_texts(kind)
    held = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(held, held.select("doc_id", "toxic").where("doc_id % 4 != 2"))
    got = {r.doc_id: r.predicted for r in toxicity.score(held.drop("toxic"), model).collect()}
    tested = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([a == b for a, b in tested]) > 0.95
    assert np.mean([b for a, b in tested if a]) > 0.95 and np.mean([a for a, b in tested if b]) > 0.95


@pytest.mark.parametrize("fillers", [150, 2500])
def test_toxicity_learns_rare_pairs_among_many_words(spark, fillers):
    """Toxic only where two words meet that are neutral alone, each in a few hundredths of the texts, whatever else there is."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("rin", "sat", "tov", "wex", "yul") for c in (f"{x}{y}" for x in "abcdefghij" for y in "abcdefghij")][:fillers]
    rows = []
    for i in range(8000):
        t = [rng.choice(vocabulary) for _ in range(20)]
        kind = rng.random()
        t += ["zorgon", "vexil"] if kind < 0.015 else ["zorgon"] if kind < 0.03 else ["vexil"] if kind < 0.045 else []
        rng.shuffle(t)
        rows.append((i, " ".join(t), int(kind < 0.015)))
    held = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(held, held.select("doc_id", "toxic").where("doc_id % 4 != 2"))
    got = {r.doc_id: r.predicted for r in toxicity.score(held.drop("toxic"), model).collect()}
    tested = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([a for a, y in tested if y]) > 0.9 and np.mean([y for a, y in tested if a]) > 0.9


def test_toxicity_scores_agree_with_a_plain_machine(spark):
    """Each score is bias, weights and the sum over all pairs of features, written out."""
    rows = labelled_texts("insult", 1200)
    held = spark.createDataFrame([*rows, (-1, None, None), (-2, "nothing known", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(held, held.where("toxic is not null").select("doc_id", "toxic"))
    place = {int(h): i for i, h in enumerate(model.terms)}
    got = {r.doc_id: r.score for r in toxicity.score(held.drop("toxic"), model).collect()}
    for i, t, _ in [*rows[:60], (-1, None, None), (-2, "nothing known", None)]:
        features = sorted({place[int(h)] for h in toxicity.terms(pa.array([t], pa.string()))[1] if int(h) in place})
        z = model.bias + sum(model.weights[f] for f in features) + sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(features) for b in features[:n])
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_does_not_depend_on_the_order_of_rows(spark):
    """Equal texts with different labels, and repeated ids, in any order."""
    rows = [(i, f"plain words {i % 9}" if i % 3 else f"scum words {i % 9}", int(i % 3 == 0 and i % 2)) for i in range(300)]
    rows += [(r[0], r[1], 1 - r[2]) for r in rows[:40]]
    scores = []
    for seed, parts in ((0, 1), (1, 3), (2, 7)):
        random.Random(seed).shuffle(rows)
        held = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(parts)
        model = toxicity.fit(held.select("doc_id", "text"), held.select("doc_id", "toxic"))
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(held.select("doc_id", "text"), model).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs.select("doc_id", "text"), model).collect()} == {0}


# op4


def brute_topk(rows, k=5, every=50):
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in held if i % every == 0}):
        best = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for j, u in held if j == q for i, v in held if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [30, 4096])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "LEAST_BLOCK", block)
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 330)] + [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, rows[0][1]), (450, []), (451, [1.0]), rows[7], (7, rows[8][1]), (50, rows[9][1])]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = sorted(tuple(r) for r in topk_search.search(held, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_topk([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


@pytest.mark.parametrize("size", [1e3, 1e6, 1e12])
def test_topk_of_great_components(spark, monkeypatch, size):
    """Exact where doubles are not; vectors have few components, so that scores fit 64 bits, and near ties."""
    monkeypatch.setattr(topk_search, "LEAST_BLOCK", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    rng = np.random.default_rng(4)
    small = [(i, [float(x) for x in rng.integers(-3, 4, 8)]) for i in range(120)]
    big = [(i + 120, [size + float(rng.integers(0, 3)), *(float(x) / 256 for x in rng.integers(0, 3, 7))]) for i in range(60)]
    rows = small + big if size < 1e6 else [(i, v) for i, v in small] + [(i, v if i % 50 else [1.0 / 256, *v[1:]]) for i, v in big]
    got = sorted(tuple(r) for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    expected = brute_topk(rows)
    assert max(abs(r[3]) for r in expected) < 1 << 63
    assert got == expected


def test_a_score_beyond_64_bits_is_an_error(spark):
    held = spark.createDataFrame([(0, [8e6] * 8), (1, [8e6] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk_search.search(held, F.col("vec_id") % 50 == 0).collect()
    held = spark.createDataFrame([(0, [8e6] * 8), (1, [-1.0] * 8), (2, [3e38] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk_search.search(held, F.col("vec_id") % 50 == 0).collect()


def test_topk_of_few(spark):
    held = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.search(held, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]


# op5


@pytest.mark.parametrize("texts", [["", "a", " a", "a  b", "a \n b", "a\nb\n\nc", "\n", "a\rb c", "x <|endoftext|> y<|endoftext|>", "tab\tx y", "a b ", "ж ж z", "don't 've\n'll x", "a\n\r b", "\r", "\ra b", "a\u3000b \xa0c\x1cd \x1ce"], [r[1] or "" for r in make()]])
def test_ids_are_those_of_the_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.WordEncoder(packing.VOCABULARY)
    for _ in range(2):
        assert [encode.encode(t) for t in texts] == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packing(docs):
    encode = packing.WordEncoder(packing.VOCABULARY)
    got = packing.pack(docs).toPandas()
    ids = {k: encode.encode(r[1] or "") + b"\0\0\0\0" for k, r in table(make()).items()}
    times = Counter(r[0] for r in make())
    assert set(got["doc_id"]) == set(ids)
    for k, pieces in got.groupby("doc_id"):
        n = len(ids[k]) // 4
        covered = Counter(i for p in pieces.itertuples() for i in range(p.start, p.start + p.length))
        assert covered == Counter(dict.fromkeys(range(n), times[k]))
        for p in pieces.itertuples():
            assert p.doc_tokens == n and p.ids_crc32 == zlib.crc32(ids[k][4 * p.start : 4 * (p.start + p.length)])
    sequences = got.sort_values(["sequence_id", "offset"])
    assert (sequences["offset"] == sequences.groupby("sequence_id")["length"].cumsum() - sequences["length"]).all()
    fill = sequences.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 1024 and sorted(fill.index) == list(range(len(fill)))
    padded = np.where(fill & (fill - 1) == 0, fill, 1024).sum()
    assert padded - fill.sum() < 1024 + 0.02 * fill.sum()


@pytest.mark.parametrize("seed", range(3))
def test_cutting_stock_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    demand = Counter(rng.integers(1, 64, 400).tolist())
    plan = packing.solve(dict(demand), 64)
    got = Counter()
    for pattern, n in plan:
        assert sum(k * v for k, v in pattern.items()) <= 64
        got.update({k: v * n for k, v in pattern.items()})
    assert got == demand and sum(n for _, n in plan) <= 1.06 * sum(k * v for k, v in demand.items()) / 64 + 3
    assert packing.solve({}) == []


# op6


def test_url_filter(spark):
    urls = ["https://a.example.net/en/1", "http://example.net/en/x?y", "http://Example.NET/de/", "http://x.example.com/de/7", "http://org/fr/", "http://a.org/fr", "http://badorg/fr/", "net/", "http://net", "http://u.net/?q", "ftp://a.b.org/fr/a#f", "http://q/ads/x", "http://q/ads/a/opt-out", "http://q?phpsessid=1", "http://malware", "x://a://b.net/", "", "no scheme", None, "http://[::1]/en/", "http://ads.q/x", "http://q/ADS/x", "http:///x", "http://a.example.net/EN/"]
    held = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)] + [(None, urls[0], "h")], "page_id long, url string, html string").withColumns({"rule": F.lit(1), "host": F.lit(2)})
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(held, url_filter.rule_table(spark)).collect()}
    db = duckdb.connect()
    pages = held.toPandas()  # noqa: F841
    db.register("pages", held.select("page_id", "url").toPandas().astype({"page_id": "Int64"}))
    expected = {tuple(None if x is None or x is pd.NA or x != x else x for x in r) for r in db.sql(url_filter.SQL).fetchall()}
    assert got == expected
    verdict = dict(zip(urls, (next(r[4] for r in got if r[0] == i) for i in range(len(urls))), strict=True))
    assert verdict["http://q/ads/x"] == "block" and verdict["http://q/ads/a/opt-out"] == "allow" and verdict["http://q?phpsessid=1"] == "block"
    with pytest.raises(ValueError):
        url_filter.rule_table(spark, (), (("*", "block"),))


def test_no_column_name_clashes(spark):
    """Names that the work itself uses stay, with what they held."""
    names = ["_url", "_best", "_key", "subject", "token", "at", "row", "a.b", "_print", "_low", "node", "root", "id", "_salt"]
    rows = [(i, f"http://sub.example.net/en/{i}", "one two three four five six", *names) for i in range(3)]
    held = spark.createDataFrame(rows, ["page_id", "url", "text", *names])
    for found in (url_filter.judge(held, url_filter.rule_table(spark)), simhash.near_duplicates(held, key="page_id")):
        assert [[r[c] for c in names] for r in found.collect()] == [names] * 3
    assert {r["component_id"] for r in simhash.near_duplicates(held, key="page_id").collect()} == {0}


def test_url_filter_of_one_hot_url(spark):
    held = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 > 0, F.lit("http://a.net/hot")).otherwise(F.concat(F.lit("http://q.io/"), "id")).alias("url"))
    got = {(r.rule, r.verdict): r["count"] for r in url_filter.judge(held, url_filter.rule_table(spark)).groupBy("rule", "verdict").count().collect()}
    assert got == {("net/", "block"): 2700, (None, "allow"): 300}


def test_tokens_of_patterns():
    assert url_filter.pattern_tokens("||example.net/en/") == ["example", "net", "en"]
    assert url_filter.pattern_tokens("/ads/*/opt-out^") == ["ads", "opt", "out"] and url_filter.pattern_tokens("foo*bar") == []


# op7


def plain_fingerprint(text):
    w = [x.lower() for x in words(text)]
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4]
    root = roots(len(rows), links)
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, k), k)
    expected = sorted((k, f, least[r]) for (k, f), r in zip(rows, root, strict=True))
    got = sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == expected and len({x[2] for x in got}) < len({x[0] for x in got}) - 3
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted({x[2] for x in expected})


@pytest.mark.parametrize("bucket,nodes", [(8, 0), (1024, 1 << 24), (1024, 1 << 40)])
def test_links_keep_every_component(spark, monkeypatch, bucket, nodes):
    """Chunks of buckets, and more blocks, lose no link."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:6]:
        for _ in range(15):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    plain = simhash._blocks
    monkeypatch.setattr(simhash, "_blocks", lambda n, r: plain(nodes or n, r))
    held = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(held, 4, bucket).collect()]
    number = {p: i for i, p in enumerate(prints)}
    assert all((a ^ b).bit_count() > 0 for a, b in edges)
    expected = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert roots(len(prints), [(number[a], number[b]) for a, b in edges]) == expected


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (300, 100)] + [(500, i) for i in range(501, 520)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[300] == got[95] == got[100] == 90 and got[519] == 500


# op8


def test_lattice_sums_all_segmentations():
    weight = {bytes([i]): -9.0 for i in range(256)} | {b"\xe2\x96\x81": -3.0, b"ab": -2.0, b"\xe2\x96\x81a": -2.5, b"abc": -3.0, b"bc": -1.0}
    lattice = lattice_lm.Lattice(weight)

    def plain(text):
        return 1.0 if not text else sum(math.exp(weight[text[:i]]) * plain(text[i:]) for i in range(1, len(text) + 1) if text[:i] in weight)

    def counts(text):
        """Weighted piece counts over all segmentations."""
        if not text:
            return [(1.0, Counter())]
        return [(math.exp(weight[text[:i]]) * w, c + Counter([text[:i]])) for i in range(1, len(text) + 1) if text[:i] in weight for w, c in counts(text[i:])]

    held = [b"a", b"abc", b"", b"abcab", b"zz"]
    got = lattice.log_probabilities(held)
    assert all(math.isclose(x, math.log(plain(lattice_lm.SPACE + w))) for x, w in zip(got, held, strict=True))
    expected, times = Counter(), [3, 1, 2, 5, 1]
    for w, k in zip(held, times, strict=True):
        paths = counts(lattice_lm.SPACE + w)
        for x, c in paths:
            for p, n in c.items():
                expected[p] += k * n * x / sum(x for x, _ in paths)
    shares = dict(zip(lattice.pieces, lattice.expect(held, times), strict=True))
    assert all(math.isclose(shares[p], expected[p], rel_tol=1e-9, abs_tol=1e-12) for p in shares)
    assert lattice.log_probabilities([b"q" * 5000])[0] < -1000 and abs(lattice.expect([b"q" * 5000], [1]).sum() - 5001) < 1e-6


@pytest.mark.parametrize("common", [5, 100_000])
def test_lm_base_and_score(docs, common):
    rows = {}
    for r in docs.collect():
        rows.setdefault(r.doc_id, [w.lower() for w in words(r.text)])
    learn = [r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    count = Counter(w for k in learn for w in rows[k])
    total, kinds = sum(count.values()) + len(learn), len(count) + 1
    got = lattice_lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, common=common).collect()
    assert len(got) == docs.count()
    for r in got:
        w = rows[r.doc_id]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w) + math.log10((len(learn) + 0.5) / (total + 0.5 * (kinds + 1)))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(w) + 1 and r.n_known == sum(count[x] > 0 for x in w) + 1 and r.train_tokens == total
        assert r.score < 0


def test_lm_scores_are_sums_over_segmentations(docs, spark):
    """score by the fitted weights and vocab_score by the vocabulary's own, each summed over every way to cut each word."""
    rows = [(r[0], " ".join(w.decode()[:6] for w in words(r[1])[:8])) for r in make()[:40]]
    held = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lattice_lm.score(held, F.col("doc_id") % 5 == 1).collect()}
    learn = [words(t.lower()) for i, t in rows if i % 5 != 1]
    count = Counter(w for t in learn for w in t)
    counted = spark.createDataFrame([(w.decode(), n) for w, n in count.items()], "word string, c long")
    fitted, end = lattice_lm.piece_weights(counted, len(learn), lattice_lm.VOCABULARY)
    assert math.isclose(sum(map(math.exp, fitted.values())) + math.exp(end), 1, rel_tol=1e-9)
    shares = lattice_lm.vocabulary_shares()
    assert math.isclose(sum(shares.values()), 1, rel_tol=1e-9)
    scores = {p: lattice_lm.processor(lattice_lm.VOCABULARY).get_score(i) for i, p in enumerate(lattice_lm.piece_bytes(lattice_lm.VOCABULARY)) if p and len(p) > 3}
    ranked = sorted(scores, key=lambda p: -scores[p])
    assert all(shares[a] >= shares[b] for a, b in zip(ranked, ranked[1:], strict=False))
    ends = (len(learn) + 0.5) / (sum(count.values()) + len(learn) + 1)

    def total(text, weight):
        through = [1.0] + [0.0] * len(text)
        for j in range(1, len(text) + 1):
            through[j] = sum(through[i] * weight(text[i:j]) for i in range(j))
        return through[-1]

    for i, t in rows:
        one = sum(math.log10(total(lattice_lm.SPACE + w, lambda p: math.exp(fitted[p]) if p in fitted else 0.0)) for w in words(t.lower())) + end / math.log(10)
        two = sum(math.log10(total(lattice_lm.SPACE + w, lambda p: shares.get(p, 0.0) * (1 - ends))) for w in words(t.lower())) + math.log10(ends)
        assert math.isclose(got[i].score, one, rel_tol=1e-9) and math.isclose(got[i].vocab_score, two, rel_tol=1e-9)


def test_lm_scores_are_sums_over_words(docs):
    got = {r.doc_id: r.score for r in lattice_lm.score(docs, F.lit(False)).collect()}
    again = {r.doc_id: r.score for r in lattice_lm.score(docs, F.lit(False), common=3).collect()}
    assert all(math.isclose(got[k], again[k], rel_tol=1e-9) for k in got)


# op9


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "ing", "tion", "and"], "de": ["sch", "ung", "ein", "ß"], "fr": ["eau", "é", "que", "ou"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(40)), k) for i in range(300) for k in [list(syllables)[i % 3]]]
    held = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "en"), (902, "123 !!!", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = language_id.fit(held, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in language_id.identify(held, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if i % 5 == 0]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert sum(got[i].rejected for i, *_ in rows) == 0


def test_language_id_with_many_values_of_the_column(spark):
    """Values that one text has are no prediction, and cost no memory."""
    rows = [(i, ["the thing and that", "ein schöner satz ist", "une école à côté"][i % 3] + f" {i}", ["en", "de", "fr"][i % 3]) for i in range(90)]
    rows += [(100 + i, f"noise{i} noise", f"x{i}") for i in range(60)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(held, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language_id.identify(held, model).collect()}
    assert model.names == ["de", "en", "fr"] and all(got[i] == k for i, _, k in rows[:90])


def test_language_id_learns_any_number_of_languages(spark):
    """Each of 230 languages has letters of its own."""
    rows = []
    for k in range(230):
        own = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(k * 10 + i, " ".join("".join(own[(7 * i + j) % 40 : (7 * i + j) % 40 + 3]) for j in range(30)), f"lang{k}") for i in range(4)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(held, F.col("doc_id") % 10 != 3)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(held, model).collect()}
    assert len(model.names) == 230 and np.mean([got[i] == k for i, _, k in rows if i % 10 == 3]) > 0.95


def plain_nearest(train, texts):
    """Nearest of plain centroids of whole n-gram counts, one a language, by cosine."""
    grams = lambda t: Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    sums, frequency = {}, Counter()
    for t, k in train:
        g = grams(t)
        frequency.update(g.keys())
        sums.setdefault(k, Counter()).update({x: math.log1p(n) for x, n in g.items()})
    idf = lambda x: math.log((1 + len(train)) / (1 + frequency[x])) + 1
    centroids = {k: {x: v * idf(x) for x, v in c.items()} for k, c in sums.items()}
    norm = {k: math.sqrt(sum(v * v for v in c.values())) for k, c in centroids.items()}
    best = lambda t: max(sorted(centroids), key=lambda k: sum(math.log1p(n) * idf(x) * centroids[k].get(x, 0.0) for x, n in grams(t).items()) / norm[k])
    return [best(t) for t in texts]


def test_language_id_agrees_with_plain_centroids(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(w) for _ in range(rng.randint(8, 60))).lower(), k) for i in range(200) for k, w in [[("en", ENGLISH), ("de", GERMAN)][i % 2]]]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(held, language_id.fit(held, F.col("doc_id") % 5 != 0)).collect()}
    plain = plain_nearest([(t, k) for i, t, k in rows if i % 5], [t for i, t, _ in rows if i % 5 == 0])
    assert [got[i] for i, *_ in rows if i % 5 == 0] == plain


def test_language_id_rejects_what_is_far(spark):
    held = spark.createDataFrame([(i, "the thing and the other thing is that and this", "en") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(held, F.lit(True))
    far = spark.createDataFrame([(1, "zxqj kvwzq xqzzj", None)], "doc_id long, text string, lang string")
    assert language_id.identify(far, model).first().rejected


ENGLISH = "the a of and to in is was that it for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house world".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schon wenn habe seine ihre dann unter wir soll ich eines kann gegen vom können wieder ihr immer zwischen viele jetzt sehr weil alle diese heute Jahre ohne sagt mehrere müssen Menschen würde gibt damit Straße geht Leben Schule Kinder Arbeit Welt Frage Stadt Land Zeit Wasser Freund spielen lernen schreiben machen später während größer schön wichtig".split()


def test_language_id_rejects_long_texts_of_no_language_and_keeps_short_ones(spark):
    rng = random.Random(9)
    text = lambda words, k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, text(words, rng.randint(20, 400)), k) for i in range(160) for k, words in [[("en", ENGLISH), ("de", GERMAN)][i % 2]]]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    letters = lambda alphabet, k: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(k))
    latin = "abcdefghijklmnopqrstuvwxyz"
    far = [letters(latin, 20), letters(latin, 100), letters(latin, 2000), letters(latin + latin.upper() + "0123456789+/", 300).replace(" ", ""), letters("абвгдежзийклмнопрстуфхцчшщыьэюя", 100), letters([chr(0x4E00 + i) for i in range(3000)], 100)]
    near = [text(words, k) for words in (ENGLISH, GERMAN) for k in (1, 2, 3, 6, 20, 100, 1000) for _ in range(10)]
    near = [t for t in near if len(t) > 3]
    held = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string")
    got = [r.rejected for r in language_id.identify(held, model).orderBy("doc_id").collect()]
    assert got == [True] * len(far) + [False] * len(near)


# op10


def test_media_feature(spark):
    held = spark.createDataFrame([(0, "aB c" * 32), (1, None)], "doc_id long, text string")
    got = {r.doc_id: r.feature for r in media.measure(media.store(held)).collect()}
    body = b"aB c" * 32
    shares = [sum(a <= x < b for x in body) * 1000 // len(body) for a, b in ((0, 33), (33, 97), (97, 128), (128, 256))]
    assert got[0] == f"64x2;mean={sum(body) // len(body)};kinds=4;shares={'/'.join(map(str, shares))}"
    assert got[1] == "64x1;mean=0;kinds=1;shares=1000/0/0/0"


def test_media(docs):
    got = media.measure(media.store(docs.select("doc_id", "text", "score"))).collect()
    assert len(got) == docs.count()
    for r in got:
        body = (table(make())[r.doc_id][1] or "").encode()
        payload = body + b"\0" * (-len(body) % 64 if body else 64)
        stored = media.to_images(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.n_bytes, r.media_bytes, r.media_sha256, r.score) == (len(body), len(stored), hashlib.sha256(stored).hexdigest(), "own")
    image = media.pixels(media.store(docs.where("doc_id = 1").select("doc_id", "text"))).first()
    assert image.width == 64 and len(image.pixels) == 64 * image.height


# all


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    results = [
        mixing.mix(empty), substrings.remove_repeats(empty), toxicity.score(empty, toxicity.fit(empty, labels)), packing.pack(empty), simhash.near_duplicates(empty), simhash.keep_one(empty),
        lattice_lm.score(empty, F.lit(False)), language_id.identify(empty, language_id.fit(empty, F.lit(True))), media.measure(media.store(empty)),
        topk_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)), url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rule_table(spark)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


CONTRACT = {
    "op1_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op2_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op8_lattice_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_media_webp": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}
FOLDS = {"op3_toxicity": (4, 2), "op8_lattice_lm": (5, 1), "op9_language_id": (5, 0)}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_query_keeps_its_contract(spark, duck, name):
    """Columns and types, one row a document where that is said, folds by id, and values where a plain version gives them."""
    held = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert CONTRACT[name].items() <= dict(held.dtypes).items()
    got = held.toPandas()
    docs = duck.sql("select doc_id, text from documents").fetchall()
    if "doc_id" in got and name != "op5_packing":
        assert sorted(got["doc_id"]) == sorted(d[0] for d in docs)
    if name in FOLDS:
        n, k = FOLDS[name]
        assert all(h == (zlib.crc32(str(i).encode()) % n == k) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    by_id = got.set_index("doc_id") if "doc_id" in got else None
    if name == "op2_substring_dedup":
        for (i, _), (n, gone, kept) in zip(docs, without_repeats([t for _, t in docs]), strict=True):
            assert tuple(by_id.loc[i, ["n_words", "n_removed", "kept_sha256"]]) == (n, gone, hashlib.sha256(kept).hexdigest())
    if name == "op7_simhash":
        assert all(by_id.loc[i, "fingerprint"] == f"{plain_fingerprint(t):016x}" for i, t in docs)
    if name == "op10_media_webp":
        for i, t in docs:
            payload = (t or "").encode() + b"\0" * (-len((t or "").encode()) % 64 if t else 64)
            assert by_id.loc[i, "payload_sha256"] == hashlib.sha256(payload).hexdigest() and by_id.loc[i, "tail_crc32"] == zlib.crc32(payload[-64:])


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.sql(registry.ORACLE[name]).df()
    names = sorted(theirs.columns)
    plain = lambda f: sorted((tuple(None if x is None or x != x else x for x in r) for r in f[names].itertuples(index=False)), key=repr)
    assert sorted(ours.columns) == names and plain(ours) == plain(theirs)
