"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import bagminhash, bpe, line_dedup, packing, quality
from terrace.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; low quality and toxic ones go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated and nearly repeated lines; those that lose every line go."""
    rows = line_dedup.dedup_lines(docs)
    rows = rows.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return bagminhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' tokens."""
    return packing.pack_documents(docs, bpe.ship_lexicon(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup_stage), ("MinHash near-dedup", near_dedup), ("packing", pack)]

#: The stages fit models and hash texts: SQL can't express them, so tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda rows, stage: written(stage[1](spark, rows, sf_dir), "stage"), STAGES, docs)
