"""Cutting lineage where what follows reads rows several times that are dear to make and few."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, and a temporary one only where that is unset and one machine does all.

    A cluster without the setting is an error, since no folder of one machine would do there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that nothing before them runs again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
