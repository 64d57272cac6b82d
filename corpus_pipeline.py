"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import packing, quality, simhash, suffix, toxicity
from tessera.llm.common import shared_dir
from tessera.sources.shipping import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose toxicity score is 0.3 or more."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)), threshold=0.3)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that fail the base test or the learned decision list."""
    return quality.keep_good(docs, quality.train(docs, _labels(spark, sf_dir)))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the smallest id."""
    return simhash.keep_one(docs, radius=2)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts every passage that 50-word strings cover which also start elsewhere; n_chars follows the text."""
    out = suffix.remove_repeats(docs, of=suffix.word_strings(50))
    return out.selectExpr(*["char_length(text) + 0L as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' ids into sequences of 2,048."""
    return packing.pack(docs, capacity=2048)


STAGES = [("toxicity", clean), ("quality rules", good), ("simhash near-dedup", unlike), ("suffix-array dedup", unrepeated), ("packing", packed)]
#: A trained model, fingerprints in groups and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written and read again by the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            at = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
    return docs
