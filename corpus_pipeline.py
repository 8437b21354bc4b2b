"""The corpus pipeline: five stages over documents, each a training-data operator applied to all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages run over whole tables; none samples or caps rows. Nulls, empty texts, repeated rows and empty tables are handled as the
operators' docstrings say: a row the quality vote rejects goes; of equal texts the longest original, then the smallest id
stays; of a near-duplicate component the smallest id stays; the mixture shows every remaining document at least once and may
repeat documents of small sources; packing places every piece of every copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.cotraining import drop_low_quality
from quillstone.llm.exact_dedup import drop_copies
from quillstone.llm.minhash import drop_near_duplicates
from quillstone.llm.mixing import mixed_documents
from quillstone.llm.packing import pack
from quillstone.session import cut, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views accept."""
    return drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again up to the mixture's weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]

#: The quality vote and best-fit packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
