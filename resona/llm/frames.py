"""DataFrame helpers of the operators: tables, cutting lineage, ranks and size-checked lookups."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, shared_folder

#: Rows up to which a lookup table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 50_000

#: A word of a text, as the operators count it (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, folds: int) -> Column:
    """crc32 of a value as text, modulo folds; a null counts as an empty text."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % folds


def lookup(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join that broadcasts the right side only if it was counted to at most BROADCAST_ROWS rows."""
    count = right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return left.join(F.broadcast(right) if count <= BROADCAST_ROWS else right, on, how)


def ranked(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """The rows with their position from 0 in the given order, without one task seeing them all.

    Range partitions are sorted and written once; only the row count of each partition, a list as
    long as the number of partitions, passes through the driver.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = cut(parts.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


#: The tables that this thread stashed within a scratch() block.
_HELD = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stashed within this block are deleted at its end: for results that are written by then."""
    _HELD.paths = []
    try:
        yield
    finally:
        for path in _HELD.__dict__.pop("paths"):
            remove(spark, path)


def stash(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared checkpoint folder, for tables too long for cut()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    if (held := getattr(_HELD, "paths", None)) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, wherever that is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted(left: DataFrame, right: DataFrame, on: list[str], by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join on a key that may be hot on the left: its rows are dealt by a hash of ``by``, and the right side, one row a key, is there for each salt."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
