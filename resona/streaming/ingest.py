"""Files that arrive in a folder: judged, set aside with a reason, or handed on once.

Each micro-batch is written as a partition of its own, by its number, so that a batch that runs again
after a failure replaces what it had written; and the checkpoint keeps a file from coming twice.
Of a file without a byte Spark gives no row and counts it as taken, as it does with one that is still
being written: files are to be moved into the folder when they are whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..sources.media import LARGEST

#: Bytes of the least header (fixed value), and the columns of a folder's files as Spark reads them.
HEADER = 44
FILES = "path string, modificationTime timestamp, length long, content binary"


def judged(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """The files with name and reason: empty (no more than a header), too large, unsupported (no WAV), short (less than its header says), or null if good."""
    head = F.hex(F.substring("content", 1, 12))
    byte = lambda i: F.substring(head, 2 * i + 1, 2)
    claimed = F.conv(F.concat(byte(7), byte(6), byte(5), byte(4)), 16, 10).cast("long") + 8
    wav = (F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57415645")
    reason = F.when((F.col("length") == 0) | wav & (F.col("length") <= HEADER), "empty").when(F.col("length") > largest, "too large").when(~wav, "unsupported").when(claimed > F.col("length"), "short")
    return files.withColumn("name", S.base_name(F.col("path"))).withColumn("reason", reason)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], largest: int = LARGEST) -> StreamingQuery:
    """A query that takes the files that are there and not yet taken, and ends.

    ``store``/accepted has what handle() makes of the good files (path, name, length, content), ``store``/rejected the
    others with their reason, both partitioned by batch.
    """
    arriving = spark.readStream.schema(FILES).format("binaryFile").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        found = judged(batch, largest)
        good = handle(found.where("reason is null").select("path", "name", "length", "content"))
        bad = found.where("reason is not null").select("path", "name", "length", "reason")
        for rows, name in ((good, "accepted"), (bad, "rejected")):
            rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
