"""From raw documents to packed training sequences, five stages over Spark.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written as Parquet and read again as the next
one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import decontaminate, language, near_copies, packing, pii
from shutterlake.llm.common import bound_batches, crc_mod, materialize, spare_names, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    bound_batches(spark)
    return language.keep_identified(docs, language.train(docs, crc_mod(F.col("doc_id"), 4) != 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest id, null last, then the smallest hash of the row."""
    bound_batches(spark)
    (key,) = spare_names(docs, "_row_key")
    kept = near_copies.first_of_classes(docs).select(F.col("row").alias(key))
    keyed = docs.withColumn(key, near_copies.row_key(docs))
    # rows that share a key are equal in every column
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verified overlap with the benchmark go."""
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), min_words=1)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    bound_batches(spark)
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: No stage of this kind can be said in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
