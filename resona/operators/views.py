"""An index of intervals: a table by length and time, so that a view reads what it can touch and nothing else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths double from level to level; the last level has all that are longer (2^40 widths).
LEVELS = 40


def index(intervals: DataFrame, path: str, width: float) -> None:
    """Write intervals (start, end, more columns) as a table whose partitions are (level, cell).

    An interval's level is the least whose cells, width * 2^level long, are no shorter than it, so it
    touches two cells at most and has two rows at most, however long it is.  Those with a null bound, or
    that end before they start, touch no view and have no row.  A crowded cell is written by several tasks.
    """
    if width <= 0:
        raise ValueError("cells have a width above 0")
    length = F.col("end") - F.col("start")
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(width)) / width)))).cast("int")
    held = intervals.where("start <= end").withColumn("level", level)
    size = F.lit(float(width)) * F.pow(F.lit(2.0), F.col("level"))
    held = held.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    held.hint("rebalance", "level", "cell").write.partitionBy("level", "cell").parquet(path)


def viewed(indexed: DataFrame, a: float, b: float, width: float) -> DataFrame:
    """The intervals of an index that touch [a, b], each once; only cells that meet the view are read.

    An interval counts in the first cell of its own that the view reaches, so its second row is no second result.
    """
    def cells(level: int):
        size = width * 2.0**level
        first, last = int(a // size), int(b // size)
        return (F.col("level") == level) & F.col("cell").between(first, last), F.greatest(F.floor(F.col("start") / F.lit(size)), F.lit(first))

    chosen = [cells(level) for level in range(LEVELS + 1)]
    near = reduce(lambda x, y: x | y, (c for c, _ in chosen))
    once = reduce(lambda x, y: x.when(F.col("level") == y[0], y[1]), enumerate(f for _, f in chosen), F)
    return indexed.where(near & (F.col("start") <= b) & (F.col("end") >= a) & (F.col("cell") == once)).drop("level", "cell")


def aligned(cells: DataFrame, hop: float, a: float, b: float, columns: int, offset: float = 0.0) -> DataFrame:
    """The cells (col, ...) of a layer at the columns ``x`` of a view of [a, b) seconds, each where its middle lies.

    A layer has columns of hop seconds from offset on, so layers of any steps and offsets meet at x.  Each cell gives
    the columns that it covers by itself: nothing is joined.  What the layer has no cell for stays empty.
    """
    if b <= a or columns < 1:
        raise ValueError("a view ends after it starts and has a column")
    wide = (b - a) / columns
    # x has its middle at a + (x + 0.5) * wide, and column c is [c, c + 1) * hop + offset
    first = lambda c: F.ceil((c * hop + offset - a) / wide - 0.5)
    low, end = F.greatest(first(F.col("col")), F.lit(0)), F.least(first(F.col("col") + 1), F.lit(columns))
    return cells.where(low < end).withColumn("x", F.explode(F.sequence(low, end - 1)))
