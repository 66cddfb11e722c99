"""The corpus pipeline: five operators applied in turn to the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aislewise.llm import classifier, exact, mixing, packing, simhash
from aislewise.llm.common import table
from aislewise.session import stored

TOKENIZER = "word_bpe_49k.json"  # a file of public_tokenizers


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so a doc_id may come twice or not at all."""
    return mixing.materialise(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 2048 tokens."""
    return packing.packed(docs, TOKENIZER).select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_dedup),
          ("SimHash near-dedup", near_dedup), ("mixing", mixture), ("packing", packed)]

#: No stage but the second can be said in SQL; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is written and is the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
