"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing and encoding, each over what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.byte_bpe import encode_documents
from scriptorium.llm.common import materialize, table
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.mixing import mixed_documents
from scriptorium.llm.ngram_join import one_of_each
from scriptorium.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the likelihood ratio keep; the trusted target is read from ``labels``."""
    return quality_rules(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked documents."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row of the mix."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixing), ("byte-level BPE", encoding)]

#: SQL cannot express the quality model, the links' components and the random draws; tests compare a small run of one source without labels by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each handles nulls in any column (a null text fails the quality rules), empty and very
    long texts, ties, repeated rows and ids, extra columns of any name, which pass through to the last stage, and empty
    tables, as its operator's docstring says."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
