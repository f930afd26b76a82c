"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import decontam, licenses, mixing, negatives, packing, pii, quality, simhash, substrings, tokens, toxicity, urls, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), keep=lambda i: ~toxicity.held_out(i)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(_table(spark, sf_dir, "pages"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.materialised(_table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(_table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_licenses, op3_simhash, op4_toxicity, op5_mixing, op6_urls, op7_substrings, op8_tokens, op9_decontam, op10_quality, op11_hard_negatives, op12_packing, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE_SQL, "op7_substrings": substrings.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL}
