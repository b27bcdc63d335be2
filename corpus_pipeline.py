"""A corpus pipeline in five stages, from raw documents to packed training sequences.

Each stage works on what its predecessor kept: poor documents go, then exact copies, then
near copies, then passages that repeat across documents; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamfield.llm import exact_dedup, ngram_jaccard, packing, quality, substring_dedup
from loamfield.llm.queries import tokenizer_file
from loamfield.llm.shared import passing, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    voters = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, voters, 0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, with the largest doc_id."""
    return exact_dedup.without_duplicates(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8 or more, with the smallest doc_id."""
    return ngram_jaccard.one_of_each(docs, 5, 80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty words that an earlier one has too."""
    return substring_dedup.without_repeats(docs, 50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"), 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

#: A classifier, a similarity join and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``, each written and read again; what a stage writes on its way goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), name, lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
