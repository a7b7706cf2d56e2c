"""The corpus pipeline: toxic documents go, one of each group of near copies stays, live secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import jaccard, packing, secrets, toxicity
from caseflow.llm.common import stored, table
from caseflow.llm.queries import BYTE_BPE, repository

#: Near copies: five-word n-grams, a Jaccard similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled documents of its input."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar word n-grams the one with the smallest id stays."""
    return jaccard.first_copies(docs, words=WORDS, percent=PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific live-looking credentials are masked in the texts; every document stays."""
    return secrets.mask(docs, repository=repository())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is tokenised and packed into sequences of 2048 ids."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("secret scans", mask_secrets), ("packing", pack)]
#: SQL has neither the classifier nor the tokenizer: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
