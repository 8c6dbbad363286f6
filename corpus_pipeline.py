"""From documents to packed sequences: five stages, each on all that the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import language_id, near_copies, packing, quality_rules, secret_scan
from strata.tables import forget, owned, release, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return language_id.keep_identified(spark, docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; short ones are no worse than others here, and stay."""
    return quality_rules.keep_by_rules(spark, docs, quality_rules.KEEP_SHORT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity of 0.8 or more): the one with the smallest id."""
    return near_copies.keep_one_of_similar(spark, docs, least=80, width=5)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks where secrets were."""
    return secret_scan.redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packing(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]

#: Fingerprints and token ids have no SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written before the next begins; then what it has kept in the shared folder goes, and so does the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = uuid.uuid4().hex
    for name, work in STAGES:
        with owned(own):
            made = work(spark, docs, sf_dir)
        before, docs = docs, settle(spark, made, f"stage-{name}")
        forget(own)
        release(before)
    return docs
