"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import exact_dedup, langid, near_dedup, packing, toxicity
from tracewright.llm.common import materialize, read_table


#: Words that a worker remembers for a stage: fewer than the operators alone would, as executors have served other stages before.
WORDS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"), memo=WORDS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, memo=WORDS)


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("exact_dedup", unique),
    ("near_dedup", distinct),
    ("packing", packed),
]

#: No SQL: classifiers, alignment and packing aren't expressible. tests/llm compares what each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
