"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.

Defined cases, in every stage: a null text counts as empty (and stays null); rows
with a null id or a repeated id are judged by their text, not by their id; an
empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cubeline.llm import exact_dedup, ngram_join, packing, pii, quality
from cubeline.llm.scratch import Scratch, released


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; without labels, all."""
    return quality.keep_quality(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, one without an id last."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of similar texts; texts without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; null texts stay null."""
    return pii.mask_pii(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences; a null or empty text is its end mark."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("pii", personal_data),
    ("packing", pack_sequences),
]

#: Learned weights and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    read = None
    for name, stage in STAGES[:-1]:
        with released(spark):  # what the operators kept is of no use once the stage is written
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if read is not None:
            scratch.drop(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)
