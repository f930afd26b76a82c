"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again for the
next one. All stages but the last return the columns of documents, and any others that docs has.

Null and empty texts fail the quality rules, so later stages see none from the first one on; a stage on its own takes them as its operator does. Texts of any length are read whole. Of repeated rows near-dedup
keeps one. A table that is empty, or of which nothing is kept, gives an empty table with the stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import decontam, mixing, quality, simhash, tokens
from tallyspan.plans.scratch import new_path, store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return quality.keep(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents are taken as often as its target asks for."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids at their places in training order, written as shards and read back from them."""
    return tokens.written(docs, new_path(spark, "shards"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids)]

#: Trained models, shingle hashes and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
