"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept. The first four return the columns of
documents; the last returns the pieces of packed sequences. Between stages the result
is a Parquet table in the shared checkpoint folder, so a lost executor costs one stage
at most; a table goes when the stage that reads it is done. No documents give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import kit, neardup, packing, pii, quality, suffixes


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go.

    A null text is empty and goes; a null language is a language; repeated rows go or stay together.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Texts without words are no duplicates; rows with a null id stay; rows that share an id go or stay together.
    """
    gone = kit.settle(neardup.link(docs, size=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct())
    # Few ids go to the documents; only where they are many are texts shuffled.
    few = gone.count() * 8 <= 8 << 20
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document with a smaller id also holds are cut out; characters stay whole.

    A null text stays null; rows that share an id, or have none, keep what they share.
    """
    return _measured(suffixes.strip(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; null texts stay null, repeated rows change alike."""
    return _measured(pii.mask(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids; a null text is the end id alone, repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed_sequences),
]

#: Encoding and packing are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. The table before the last stage stays in the checkpoint folder, for the result to be read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{kit.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            kit.remove(spark, f"{top}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
