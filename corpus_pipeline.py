"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import decontaminate, jaccard_join, line_dedup, quality, queries, sentencepiece_bpe
from duelframe.session import cut_lineage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_rejected(docs, queries.table(spark, sf_dir, "labels"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents of which nothing is left, such as exact copies."""
    return line_dedup.drop_lines(docs, drop_emptied=True)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard_join.keep_first(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their counts and digests."""
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode(docs, queries.vocabulary()))


STAGES = [("quality", classify), ("line_dedup", dedupe_lines), ("jaccard_join", dedupe_documents), ("decontaminate", decontaminate_documents), ("sentencepiece", tokenise)]
#: The classifier and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
