"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glossweave.llm import bpe, decontam, line_crf, line_dedup, near_dup
from glossweave.llm.common import delete, read, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines a conditional random field finds good enough.

    A null text is as an empty one, whose score is 0, so it goes; null ids are scored like others; an empty table stays one.
    """
    return line_crf.accepted(docs, read(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold line by line.

    Null ids and texts stay as they are; a document that loses all its words goes.
    """
    return line_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8.

    Texts without words, null ones too, are duplicates of nothing and stay; rows of one doc_id stay or go together.
    """
    return near_dup.one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts hold none and stay; null and blank items are not searched.
    """
    return decontam.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of these and of what they decode to.

    A null text is as an empty one, without ids; repeated rows each have a row.
    """
    return bpe.digests(docs, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("bpe", tokenize)]

#: Trained models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written to the shared folder and read again; only the last one's files stay."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
