"""Results kept by content: fingerprints, retention, publishing as partitions of a table, and the progress of a group of jobs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEPT = 8
#: Partition columns of kept results.
PLACE = ("store_version", "store_params", "store_key")


def params_key(params: dict[str, Any]) -> str:
    """The first 16 hex digits of the SHA-256 of the canonical JSON of the parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def row_key(*columns: str) -> Column:
    """The same of columns, named in sorted order, in a row's JSON."""
    return F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(16))


def newest(entries: DataFrame, by: str, at: str, tie: str, n: int = KEPT) -> DataFrame:
    """The last n entries of each group."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return entries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def unknown(names: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """Names that the registry does not have."""
    return names.select(column).distinct().join(registry.select(column), column, "left_anti")


def _place(key: str, params: dict[str, Any], version: str) -> dict[str, str]:
    for name in (key, version):
        if not re.fullmatch(r"[A-Za-z][\w.-]*", name):
            raise ValueError(f"{name!r} does not name a folder: a letter, then letters, digits, _, . and -")
    return dict(zip(PLACE, (version, params_key(params), key), strict=True))


def put(df: DataFrame, folder: str, key: str, params: dict[str, Any], version: str) -> None:
    """Write a result as one partition of the table in a folder, in place of the one that was there.

    Spark writes the files beside the table and moves the partition when all tasks are done.  The
    partition's folder is named by version, parameters and key.  A result without rows leaves no folder.
    """
    held = df.withColumns({c: F.lit(v) for c, v in _place(key, params, version).items()})
    held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(folder)


def find(spark: SparkSession, folder: str, key: str, params: dict[str, Any], version: str) -> DataFrame | None:
    """The result, or None where there is none of this version and these parameters: a miss is no error."""
    path = "/".join((folder, *(f"{c}={v}" for c, v in _place(key, params, version).items())))
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def get(spark: SparkSession, folder: str, key: str, params: dict[str, Any], version: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result that is there, else the one made now and kept."""
    found = find(spark, folder, key, params, version)
    if found is None:
        put(made := make(), folder, key, params, version)
        found = find(spark, folder, key, params, version)
        return made.limit(0) if found is None else found
    return found


def listed(spark: SparkSession, folder: str, n: int = KEPT) -> DataFrame:
    """(the partition columns, at) of the n results that were written last, from the files' footers."""
    held = spark.read.schema(", ".join(f"{c} string" for c in PLACE)).parquet(folder)
    entries = held.groupBy(*PLACE).agg(F.max("_metadata.file_modification_time").alias("at"))
    return newest(entries.withColumn("_all", F.lit(1)), "_all", "at", PLACE[-1], n).drop("_all")


def progress(spark: SparkSession, group: str) -> float:
    """The share of tasks that are done, of the stages that a job group has begun; setJobGroup and cancelJobGroup do the rest."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(stage) for job in jobs if job for stage in job.stageIds]
    total = sum(s.numTasks for s in stages if s)
    return sum(s.numCompletedTasks for s in stages if s) / total if total else 0.0
