"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Every stage takes any columns besides those of documents, whatever their names,
and all but the last give them back; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, decontamination, exact_dedup, quality, shingle_join
from folioscope.llm.common import remainder, scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier scores below 0.7; learnt from the folds other than 2 of 4.

    Null and empty texts get the score of an empty text; equal texts get equal
    scores, so repeated rows stay or go together; without labels all stay.
    """
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return quality.keep_good(docs, quality.train(docs, labels), threshold=0.7)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; null is equal to empty, a null doc_id is smaller than any other, and of rows that share doc_id and text one stays."""
    return exact_dedup.keep_one(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 0.8 or more of their five-word shingles, the smallest doc_id stays.

    Texts without words (null, empty, white space) and rows with a null doc_id are joined with nothing
    and stay; repeated rows of the one that stays all stay.
    """
    return shingle_join.keep_first(docs, n_words=5, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edits allowed for; null and empty texts and items match nothing, short items whole texts only."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of their decoding: a row for each row, null and empty texts with no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_filter", quality_filter),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Compression, edit distance and merge ranks have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs
