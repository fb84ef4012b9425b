"""A model as a table function finds the notes that it finds as a plain function."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from resona.operators import intervals, predictors, separation


def model():
    """A model that goes to tasks by value, as they cannot import this file: a note of each stretch above a half."""

    def loud(v):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (v > 0.5).astype(int), [0]])))
        return [(60, float(a), float(b), 0.5) for a, b in zip(edges[::2], edges[1::2], strict=True)]

    return loud


def test_same_notes_as_by_groups(spark):
    x = np.zeros(90)
    x[10:50] = x[70:75] = x[85:90] = 1.0
    held = spark.createDataFrame(pd.DataFrame({"track": ["a"] * 90 + ["b"] * 30, "n": list(range(90)) + list(range(30)), "v": [*x, *[0.0] * 30]}))
    plan = separation.chunks(held.groupBy("track").agg((F.max("n") + 1).alias("total")), separation.pulled_back(F.col("total"), 20, 4))
    rows = separation.spread(held, plan, 20)
    expected = intervals.predicted_notes(rows, model(), 1.0, 2.0)
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda p: p["v"])
    chunks = rows.groupBy("track", "chunk").agg(F.first("start").alias("start"), pairs.alias("samples"))
    predictors.register(spark, "loud_notes", model())
    got = predictors.predicted(chunks, "loud_notes", 1.0, 2.0)
    names = ["track", "pitch", "start", "end", "conf"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, expected.select(names).collect()))
    assert sorted((r.start, r.end) for r in got.collect()) == [(10.0, 50.0), (70.0, 75.0), (85.0, 90.0)]


def test_from_sql_and_with_nothing_to_hear(spark):
    predictors.register(spark, "loud_notes", model())
    spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, []), (3, None), (4, [0.0])], "id int, samples array<double>").createOrReplaceTempView("heard")
    got = spark.sql("select h.id, p.pitch, p.start, p.end from heard h, lateral loud_notes(h.samples) p").collect()
    assert [tuple(r) for r in got] == [(1, 60, 0.0, 2.0)]
    none = spark.createDataFrame([], "track string, start long, samples array<double>")
    assert predictors.predicted(none, "loud_notes").count() == 0
