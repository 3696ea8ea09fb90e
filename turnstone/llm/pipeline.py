"""A training corpus from documents: five stages, each over all that the one before kept.

Each stage is a function of (spark, docs, sf_dir) and keeps docs' columns, but for the last. What a stage does with odd
rows is what its operator does: null and empty texts are rejected by the classifier, which needs a perplexity; repeated
rows of one doc_id are one near-duplicate class, of which one row stays, the one of the least text hash; rows without
doc_id pass the near-duplicate stage, get certain copies alone from the mix and are packed; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import mixing, neardup, packing, pii, quality
from turnstone.llm.common import documents, drop, stage
from turnstone.llm.queries import tokenizer_path


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model of trusted text doesn't reject."""
    return quality.keep_good(docs, quality.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each class of near-duplicates."""
    return neardup.keep_first(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pii.replace_all(docs).select("doc.*")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", good_only), ("near-duplicates", one_of_each), ("surrogates", without_personal_data), ("source mix", mixed_sources), ("packing", packed)]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each one's rows are written and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            drop(before)
        before = docs
    return docs
