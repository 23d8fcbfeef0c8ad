"""The corpus pipeline: five stages over `documents`, each writing what it keeps for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import lines, packing, quality, simhash, toxicity
from larkspur.llm.common import drop_scratch, read, scratch, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.7 or more go."""
    return toxicity.keep(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current quality policy go."""
    return quality.keep(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters that a document of smaller id holds go; every document stays."""
    return lines.without_shared(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8)."""
    return simhash.near_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and the sequences that hold them."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("lines", drop_lines),
    ("near_copies", drop_copies),
    ("packing", pack),
]

#: The model's scores and the fingerprints' links are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of the tables written on the way only theirs stays."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with tidy(spark) as keep:
            docs = keep(scratch(stage(spark, docs, sf_dir), name))
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
