"""The corpus pipeline against a plain version of its stages."""

import hashlib
import math
from collections import Counter

import pytest
from test_llm_operators import DOCS, make, plain_fingerprint, roots, without_repeats, words

import corpus_pipeline
from pyspark.sql import functions as F

from resona.llm import frames, packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(make(), DOCS).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_are_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "mix_sources", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_a_plain_version(spark, folder):
    docs, held = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder).persist()
        held[name] = [tuple(r) for r in docs.collect()]
        assert docs.columns == corpus_pipeline.COLUMNS
    # rows without a letter go, and the one whose letters are like none that were learned from
    rows = [r for r in make() if r[1] and any(map(str.isalpha, r[1])) and "x x" not in r[1]]
    assert sorted(held["language_id"], key=repr) == sorted(rows, key=repr)
    # the smallest doc_id of each component, once
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    best = {}
    for r, k in zip(rows, root, strict=True):
        best[k] = min(best.get(k, r), r, key=lambda x: x[0])
    rows = sorted(best.values())
    assert sorted(held["near_dedup"]) == rows
    # repeats within what is left
    cleaned = []
    for r, (_, gone, kept) in zip(rows, without_repeats([r[1] for r in rows]), strict=True):
        text = kept.decode() if gone else r[1]
        cleaned.append((r[0], text, r[2], r[3], len(text) if gone else r[4]))
    assert sorted(held["substring_dedup"]) == cleaned and any(a != b for a, b in zip(cleaned, rows, strict=True))
    # copies
    sizes = Counter()
    for r in cleaned:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1, 5], strict=False))
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    copies = Counter()
    for r in cleaned:
        rate = min(3 * sizes[r[3]], low * weight[r[3]]) / sizes[r[3]]
        draw = int(hashlib.md5(f"{r[0]}:42".encode()).hexdigest()[:13], 16) / 2**52
        copies[r] = math.floor(rate) + (draw < rate - math.floor(rate))
    assert Counter(held["mix_sources"]) == +copies
    # every id of every copy is in one piece
    encode = packing.WordEncoder(packing.VOCABULARY)
    tokens = {r[0]: len(encode.encode(r[1])) // 4 + 1 for r in cleaned}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert dict(got.groupby("doc_id")["length"].sum()) == {r[0]: n * tokens[r[0]] for r, n in copies.items() if n}


def test_stages_with_awkward_rows(spark, folder):
    """All texts null, columns that clash, repeated rows: each stage gives a defined result."""
    docs = spark.createDataFrame([(i % 3, None, None, None, None) for i in range(6)], DOCS)
    docs = docs.withColumns({c: F.lit("own") for c in ("size", "kept", "fingerprint", "_row", "score", "length")})
    counts = {name: stage(spark, docs, folder).count() for name, stage in corpus_pipeline.STAGES}
    assert counts == {"language_id": 0, "near_dedup": 1, "substring_dedup": 6, "mix_sources": 0, "packing": 6}


def test_intermediate_tables_go(spark, folder):
    import glob

    where = frames.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{where}/*"))
    assert corpus_pipeline.run(spark, folder).count() > 0
    new = [p for p in set(glob.glob(f"{where}/*")) - before if "/table-" in p or "/pipeline-" in p]
    assert len(new) == 1 and [p.rsplit("/", 1)[1] for p in glob.glob(f"{new[0]}/*")] == ["4-packing"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
