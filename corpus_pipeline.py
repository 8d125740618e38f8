"""Documents made ready for training: quality, exact and near copies, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import exact_dedup, ngram_join, packing, personal_data, quality_model
from routeloom.llm.common import kept, only, table
from routeloom.llm.queries import BYTES

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality_model.classify(docs, table(spark, sf_dir, "labels"))
    return only(docs, judged.where("kept"), repeats=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays."""
    return exact_dedup.unique(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by near-duplicate links that of the least id stays."""
    return ngram_join.representatives(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    return personal_data.redacted(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, BYTES)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("private data", private_data),
    ("packing", packed),
]

#: Neither the classifier, MinHash classes nor token ids can be expressed in SQL; the tests follow each stage by plain means.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
