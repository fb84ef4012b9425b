"""Matching by spans against the plain loop."""

import random

import pytest

from resona.operators import matching

NOTES = "track string, id long, pitch double, start double, end double"


def plain(reference, estimate, pitch, start):
    found, taken = set(), set()
    for t, i, p, a, b in sorted(reference, key=lambda r: (r[3], r[1])):
        fits = [(-(min(b, d) - max(a, c)), c, j) for u, j, q, c, d in estimate if u == t and j not in taken and abs(q - p) <= pitch and abs(c - a) <= start and min(b, d) > max(a, c)]
        if fits:
            j = min(fits)[2]
            taken.add(j)
            found.add((t, i, j))
    return found


def notes(rng, n, dense, base):
    rows = []
    for i in range(n):
        a = round(rng.uniform(0, dense), 3)
        rows.append((rng.choice("ab"), base + i, float(rng.randint(60, 63)), a, a + round(rng.uniform(0.01, 0.4), 3)))
    return rows


@pytest.mark.parametrize("seed,dense,pitch,start,width", [(0, 20, 0.5, 0.05, None), (1, 3, 2.0, 0.2, 0.4), (2, 3, 9.0, 0.2, 0.4), (3, 1, 9.0, 0.5, 1.0), (4, 200, 0.5, 0.05, None)])
def test_spans_give_what_the_loop_gives(spark, seed, dense, pitch, start, width):
    """From sparse notes to a dense track whose every span depends on the one before."""
    rng = random.Random(seed)
    reference, estimate = notes(rng, 150, dense, 0), notes(rng, 170, dense, 1000)
    held = (spark.createDataFrame(x, NOTES).repartition(3) for x in (reference, estimate))
    got = matching.match(*held, pitch, start, width)
    assert {tuple(r) for r in got.collect()} == plain(reference, estimate, pitch, start)


def test_no_notes(spark):
    none, some = spark.createDataFrame([], NOTES), spark.createDataFrame([("a", 1, 60.0, 0.0, 1.0)], NOTES)
    assert matching.match(none, some).collect() == matching.match(some, none).collect() == matching.match(none, none).collect() == []
    with pytest.raises(ValueError):
        matching.match(some, some, start=1.0, width=1.5)
