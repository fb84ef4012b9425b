"""Periodic runs, HyperMinHash components and hard negatives against brute force, with the awkward cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from resona.llm import hard_negatives, hyperminhash, runs

DOCS = "doc_id long, text string, lang string"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


# periodic runs


def plain_runs(w, exponent=4, least=6):
    """Every maximal stretch of each period, kept if no smaller period holds on it."""
    seen = {}
    codes = np.array([seen.setdefault(x, len(seen)) for x in w], int)
    out, n = [], len(codes)
    for q in range(1, n // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes[q:] == codes[:-q], [0]])))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist(), strict=True):
            if e - s >= max(least, exponent * q, 2 * q) and not any((codes[s : e - p] == codes[s + p : e]).all() for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_of_integers(exponent, least):
    rng = random.Random(exponent)
    for _ in range(400):
        n, k = rng.randint(1, 45), rng.choice([1, 2, 3, 6])
        w = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 7)
            w = [w[i] if i < a + p else w[a + (i - a) % p] for i in range(n)]
        assert [tuple(r) for r in runs.runs_of(np.array(w, np.uint64), exponent, least).tolist()] == plain_runs(w, exponent, least)


def test_extensions_are_common_prefixes():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (60, 2), (300, 3), (90, 1)):
        text = rng.integers(1, k + 1, n)
        held = runs.Extensions(text)
        i, j = rng.integers(0, n + 1, (2, 400))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            m = 0
            while max(a, b) + m < n and text[a + m] == text[b + m]:
                m += 1
            want.append(m)
        assert held.longest(i, j).tolist() == want
        for ranked, sign in ((held.ranks, 1), (held.reverse_ranks(), -1)):
            assert ranked == sorted(range(n + 1), key=lambda s: [*(sign * text[s:]).tolist(), -(10**6)])


def test_stretches_hold_every_run_and_leave_plain_texts_out():
    rng = random.Random(5)
    rows, flat, want = [0], [], []
    for _ in range(600):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 50, 300])
        w = [rng.randint(1, k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 10)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want += [(s + len(flat), size, q) for s, size, q in plain_runs(w)]
        flat += w
        rows.append(len(flat))
    hashes = runs.K.mix(np.array(flat, np.uint64))
    found = runs.stretches(hashes, np.array(rows))
    got = [tuple(r) for a, b in found.tolist() for r in (runs.runs_of(hashes[a:b]) + [a, 0, 0]).tolist()]
    assert got == want and len(want) > 300
    plain = runs.K.mix(np.array([rng.randrange(5000) for _ in range(30_000)], np.uint64))
    assert not len(runs.stretches(plain, np.array([0, 30_000])))


def planted(doc_id, w):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_op12(doc_id, text):
    w = planted(doc_id, words(text))
    found = plain_runs(w)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(kept))


def awkward(seed=0, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = []
    for i in range(n):
        t = text(rng.randint(1, 120))
        if i % 3 == 0:
            t += "\n" + "  ".join([text(rng.randint(1, 9))] * rng.randint(3, 8)) + "\t" + text(4)
        rows.append((i, t, "en"))
    rows += [(n, None, None), (n + 1, "", "en"), (n + 2, " \t\n", "en"), (None, text(50), "en"), (None, None, None), (n + 3, "x " * 700, "en"), (n + 4, text(9000), "en"), (n + 5, "Ünï\x1c ß\xa0 " * 9, "en")]
    return [*rows, rows[3], rows[3]]


def test_periodic_runs_query(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in runs.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain_op12(i, t) for i, t, _ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_periodic_runs_keep_other_columns(spark):
    rows = [(1, "a b a b a b a b c", "own"), (2, None, None)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("own") for c in ("runs", "n_words", "_words", "start")})
    got = {r["doc_id"]: r for r in runs.periodic_runs(held).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 8, 2)] and got[1]["collapsed"] == "a b c" and got[1]["_words"] == got[1]["start"] == "own"
    assert (got[2]["n_words"], got[2]["runs"], got[2]["collapsed"]) == (0, [], "")
    assert runs.periodic_runs(held.limit(0)).collect() == []


# HyperMinHash


def plain_set(text):
    w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(key)
    out = []
    for i, (key, _, _) in enumerate(rows):
        low = min((k for k in least[find(i)] if k is not None), default=None)
        out.append((key, len(sets[i]), low, key == low))
    return sorted(out, key=str)


def copies(seed=0, groups=12):
    """Groups of copies about the threshold, chains of links, and short texts that differ in a word."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    pick = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    texts = []
    for g in range(groups):
        base = pick(rng.choice([3, 8, 25, 90, 400]))
        for _ in range(rng.randint(2, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    chain = pick(120)
    for i in range(15):
        chain = [*chain[2:], *pick(2)]
        texts.append("  ".join(chain).upper() if i % 2 else "\n".join(chain))
    texts += [" ".join(pick(rng.randint(1, 60))) for _ in range(30)] + [None, None, "", "", " \t", "one", "ONE", "one two", "one two", " ".join(pick(8000))]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[2], rows[2], (None, texts[0], "en"), (None, "only here twice", None), (None, "Only here twice", None)]


@pytest.mark.parametrize("seed,chunk", [(0, 1024), (1, 3)])
def test_hyperminhash_components(spark, seed, chunk):
    rows = copies(seed)
    held = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("node", "row", "id", "hash", "_node", "component_id", "kept", "registers", "_salt")}).repartition(3)
    got = hyperminhash.near_duplicates(held, chunk=chunk)
    assert {"node", "row", "id", "hash", "_node", "registers", "_salt"} < set(got.columns)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == plain_components(rows)
    assert hyperminhash.near_duplicates(held.limit(0)).collect() == []


def test_pairs_that_a_best_partner_does_not_join_are_still_confirmed(spark):
    """Many texts about one base, at similarities on both sides of the threshold."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en"))
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id", "kept")
    want = plain_components(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and 2 < len({r[2] for r in want}) < 65


def test_small_sets_that_differ_by_a_shingle_are_linked(spark):
    """No set of few shingles is without a key: texts and the same texts with one word more."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(8, 52))]
        rows += [(2 * i, " ".join(w), "en"), (2 * i + 1, " ".join([*w, "more"]), "en")]
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_forests_join_what_the_edges_join():
    rng = np.random.default_rng(4)
    for n, m in ((2, 1), (30, 20), (200, 2000)):
        a, b = (np.sort(rng.integers(0, n, (2, m)), axis=0))
        a, b = a[a != b], b[a != b]
        value = rng.integers(0, 5, len(a)) / 5
        held = hyperminhash.forest(a, b, value, n)

        def parts(x, y):
            label = list(range(n))
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
            return [label.index(k) for k in label]

        assert parts(a[held], b[held]) == parts(a, b) and len(held) == n - len(set(parts(a, b)))
        for level in (0.8, 0.6, 0.4):  # and what the better ones join, their better ones join
            high = value >= level
            kept = held[value[held] >= level]
            assert parts(a[kept], b[kept]) == parts(a[high], b[high])


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    found = hyperminhash.registers(hashes, np.array([0, 5000]))[0]
    for bucket in range(256):
        least = min((int(h) & ((1 << 56) - 1) for h in hashes[hashes >> np.uint64(56) == bucket]), default=None)
        if least is None:
            assert found[bucket] == 0
            continue
        least >>= 8
        zeros = 48 - least.bit_length()
        bits = (least << zeros & ((1 << 47) - 1)) >> 37 if least else 0
        assert found[bucket] == 1 + (zeros << 10) + bits
    for share in (0.85, 0.5, 0.0):
        errors = []
        for _ in range(60):
            common, n = int(2000 * share), 2000
            one = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            other = np.concatenate([one[:common], rng.integers(0, 1 << 64, n - common, dtype=np.uint64)])
            a, b = (hyperminhash.registers(np.sort(x), np.array([0, n])) for x in (one, other))
            errors.append(hyperminhash.estimate(a, b, np.array([n]), np.array([n]))[0] - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05
    unrelated = [((a := hyperminhash.registers(np.sort(rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)), np.array([0, 30_000])))[0] == found).sum() for _ in range(400)]
    assert abs(np.mean(unrelated) - hyperminhash.chance(np.array([30_000.0]), np.array([5000.0]))[0]) < 0.03 and a.shape == (1, 256)


# hard negatives


def plain_negatives(rows):
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = set()
    for i, label, v in held:
        if i % 100:
            continue
        others = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in held if j != i]
        same = sorted((-s, j) for s, j, other in others if other == label)[:5]
        for s, j in same:
            fits = sorted((-t, m) for t, m, other in others if other != label and 80 * -s <= 100 * t <= 100 * -s)[:5]
            out |= {(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fits, 1)}
    return out


def vectors(seed, n=700, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=dims) * (0.1 if i % 2 else 0.6)).astype(np.float32).tolist(), int(rng.integers(10))) for i in range(n)]
    rows[100] = (100, [0.0] * dims, 1)
    rows[101:140] = [(i, rows[200][1], rows[200][2] if i % 2 else 3) for i in range(101, 140)]
    rows += [(n, None, 1), (n + 1, rows[1][1], None), (n + 2, [None] * dims, 2), (n + 3, [float("nan")] * dims, 2), (n + 4, [float("inf")] * dims, 2), (None, rows[2][1], 2), (n + 5, rows[3][1][:4], 5), (-7, rows[5][1], 9), (1100, [3e6] * dims, 4), (1101, [3e6] * dims, 4), (1102, [2.9e6] * dims, 3)]
    rng.shuffle(rows)
    return [(None if r[0] is None else int(r[0]), None if r[1] is None else list(r[1]), r[2]) for r in rows]


@pytest.mark.parametrize("seed,block", [(0, 32_768), (1, 40)])
def test_hard_negatives(spark, monkeypatch, seed, block):
    rows = vectors(seed)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 200)
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("vector", "cell", "row", "norm", "_h")}).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(held, F.col("vec_id") % 100 == 0, label, block=block).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows) and len(got) == len({tuple(r) for r in got}) > 50


def test_repeated_anchors_and_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2), (2, [1.0, 0.9], 2)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in hard_negatives.mine(held, F.col("vec_id") == 0, F.col("label")).collect())
    near, far = 256 * 256, 256 * 230
    assert got == [(0, 1, 1, 2, near, far), (0, 1, 1, 2, near, near), (0, 1, 2, 2, near, far), (0, 1, 2, 2, near, near)]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    for scale in (1, 1e3, 1e9):
        x = np.floor(rng.normal(size=(500, 16)) * 50 * scale) + np.where(np.arange(500)[:, None] % 3 == 0, 300 * scale, 0)
        norms = np.linalg.norm(x, axis=1)
        directions = hard_negatives.directions_of(x)
        angles = hard_negatives.angles_to(x, norms, directions).astype(np.float32).astype(float)
        low, high = hard_negatives.bounds(angles, norms, angles[0], norms[0])
        exact = x @ x[0]
        assert (low <= exact).all() and (exact <= high).all() and (high - low < 1.9 * norms * norms[0]).mean() > 0.3


def test_no_hard_negatives(spark):
    held = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    everything = F.col("vec_id") >= 0
    assert hard_negatives.mine(held, everything, F.col("label")).collect() == []
    assert hard_negatives.mine(held.limit(0), everything, F.col("label")).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], held.schema), everything, F.col("label")).count() == 2
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, [3e10], 1), (1, [3e10], 1)], held.schema), everything, F.col("label")).collect()


def test_hard_negatives_equal_the_sql(spark, tmp_path):
    rows = [r for r in vectors(4, 900) if r[0] is not None]
    frame = pd.DataFrame([r for r in rows if r[1] is None or len(r[1]) == 8], columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})
    duck = duckdb.connect()
    duck.sql("create table embeddings as select vec_id, embedding::float[] as embedding, label from frame where vec_id not in (1100, 1101, 1102)")
    duck.sql(f"copy embeddings to '{tmp_path}/embeddings.parquet'")
    want = {tuple(r) for r in duck.sql(hard_negatives.SQL).fetchall()}
    assert {tuple(r) for r in hard_negatives.op13_hard_negatives(spark, str(tmp_path)).collect()} == want and len(want) > 50
    assert frame.shape[0]
