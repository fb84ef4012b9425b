"""A training corpus from raw documents, stage by stage.

Each stage is a name and a function of (spark, documents, sf_dir) that applies one operator to all
that the stage before kept; ``run`` writes each result as a table and reads it again, and deletes
what only earlier stages needed.

Cases, for every stage: null and empty texts, ids and sources go through as their operator defines
it; repeated rows and ties too; a text of any length is worked on whole; columns other than those of
documents are dropped first, so no name can clash; an empty table gives an empty one.  Language ID
drops texts that are null or have no letter, so only a caller of the later stages meets those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import frames, language_id, mixing, packing, simhash, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: null, no letter, or far from every language."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), frames.fold("doc_id", 5) != 0)
    return language_id.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id; a null id comes last."""
    return simhash.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere go; texts without any stay as they are, white space included."""
    found = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a null source is one of its own."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; a null text is the end alone."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no n-gram centroids, SimHash components or subword ids; the tests check each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    folder, last = f"{frames.shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        with frames.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            frames.remove(spark, last)
        last = path
    return docs
