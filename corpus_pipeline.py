"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``. Toxicity and
language drop the rows that they reject, near-duplicate detection keeps one row
of each class, personal data is replaced in the text, and packing returns the
pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplewright.llm import hdlang, near_copies, packing, pii, toxicity
from triplewright.llm.common import materialise, read, temporary_tables


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score as toxic go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a language go."""
    return hdlang.keep_known(docs, *hdlang.train_profiles(hdlang.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near copies (similarity of five-word shingles 0.8 or more) stays."""
    return near_copies.keep_one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data is replaced in the texts."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents as packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage writes for itself is deleted when the stage has been written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
