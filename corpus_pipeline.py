"""From raw documents to packed sequences: language, exact and near duplicates, mixture, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. The mixture's order is the order of
the rows in the files it leaves; packing hands out its sequences in that order (``sequence_order``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strophe.llm import exact_dedup, langid, mixing, near_dedup, packing
from strophe.llm.common import materialize, read, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.interleaved(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.in_stream_order(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("packing", packed)]

#: Language models, tokenizers and sketches have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's inner steps go when its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
