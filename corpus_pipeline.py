"""A training-data pipeline: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelry.llm.minhash import keep_first
from voxelry.llm.packing import pack
from voxelry.llm.quality import keep_good
from voxelry.llm.substring_dedup import remove_repeats
from voxelry.storage import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band.

    Null and empty texts, and those of fewer than 50 words, go; rows that repeat stay or go together,
    with null ids too; languages that are null or have little text share a band. No rows: none.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Texts without words and rows without id are in no group and stay; rows that repeat an id are one
    document, with the smallest of their texts, and stay or go together. No rows: none.
    """
    return keep_first(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of fifty words and more that stand earlier too: in a smaller doc_id, or before in the same one.

    Every row stays, if with a shorter text; null and empty texts stay as they are. Rows that repeat
    an id are one document: what both have at the same place stays in both. A null id is the smallest.
    """
    return remove_repeats(docs, window=50)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it: at least one a row, whatever its id or text."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packing)]

#: Perplexity, shingle sets and tokenization can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's result is written and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)  # a table of an earlier stage; nothing else is dropped
    return docs
