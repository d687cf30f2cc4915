"""The queries of this subpackage by name, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrace.llm import bagminhash, bpe, fingerprints, kneser_ney, line_dedup, media, packing, quality, url_rules, warc


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.round_trip(docs, bpe.ship_lexicon(docs, _vocabulary()))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), every_context=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup.dedup_lines(docs.select("doc_id", "text"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack_documents(docs, bpe.ship_lexicon(docs, _vocabulary()))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    # classes; the links inside a class are counted on request only, as they are quadratic in a group of near copies
    return bagminhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), all_links=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_round_trip, op2_kneser_ney, op3_line_dedup, op4_fingerprints, op5_media, op6_packing, op7_url_rules, op8_bagminhash, op9_warc, op10_quality)
}

ORACLE_SQL: dict[str, str] = {"op7_url_rules": url_rules.oracle()}
