"""Observations and segments derived from the lineitem and part tables: whole numbers only, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.plans.ranks import ranked

PURITY = 0.9
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item."""
    rows = ranked(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_quantity"), list(ORDER), "rid", keep=["l_linenumber", "l_partkey", "l_quantity"])
    depth = F.lit(50) + F.col("l_partkey") % 150
    alt = F.expr("((50 + l_partkey % 150) * cast(l_quantity as bigint)) div 100")
    bad = F.col("rid") % 97 == 0
    rows = rows.select(
        F.col("rid").alias("original_row"), (F.col("l_partkey") % 22 + 1).alias("chrom"), (F.col("rid") * 10 + F.col("l_linenumber")).cast("long").alias("pos"),
        F.when(bad, -1).otherwise(alt).cast("long").alias("alt_count"), F.when(F.col("rid") % 89 == 0, 0).when(bad, 5).otherwise(depth - alt).cast("long").alias("ref_count"),
    )
    return rows.withColumn("mutation_id", F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment per part: 6000 of every 6600 positions."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    start = F.expr("6600 * (p_partkey div 22)")
    minor = key % (2 + size % 4)
    return part.select(
        key.alias("segment_id"), (key % 22 + 1).alias("chrom"), (start + 1).alias("s_pos"), (start + 6000).alias("e_pos"),
        (1 + size % 4).alias("major_cn"), minor.alias("minor_cn"), (1 + size % 4 + minor).alias("total_cn"),
    )


SQL = """
snv AS (
  SELECT rid AS original_row, 1 + l_partkey % 22 AS chrom, 10 * rid + l_linenumber AS pos,
         CASE WHEN rid % 97 = 0 THEN -1 ELSE ((50 + l_partkey % 150) * l_quantity::BIGINT) // 100 END AS alt_count,
         CASE WHEN rid % 89 = 0 THEN 0 WHEN rid % 97 = 0 THEN 5 ELSE (50 + l_partkey % 150) - ((50 + l_partkey % 150) * l_quantity::BIGINT) // 100 END AS ref_count,
         (1 + l_partkey % 22)::VARCHAR || ':' || (10 * rid + l_linenumber)::VARCHAR AS mutation_id
  FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rid FROM lineitem)),
cna AS (
  SELECT p_partkey AS segment_id, 1 + p_partkey % 22 AS c_chrom, 6600 * (p_partkey // 22) + 1 AS s_pos, 6600 * (p_partkey // 22) + 6000 AS e_pos,
         (1 + p_size % 4)::BIGINT AS major_cn, (p_partkey % (2 + p_size % 4))::BIGINT AS minor_cn, (1 + p_size % 4 + p_partkey % (2 + p_size % 4))::BIGINT AS total_cn
  FROM part),
led AS (
  SELECT s.*, segment_id, s_pos, e_pos, major_cn, minor_cn, total_cn,
         CASE WHEN alt_count < 0 OR ref_count < 0 OR alt_count + ref_count <= 0 THEN 'invalid_counts_or_zero_depth' WHEN segment_id IS NULL THEN 'no_cna_segment' ELSE 'retained' END AS reason
  FROM snv s LEFT JOIN cna c ON s.chrom = c.c_chrom AND s.pos BETWEEN c.s_pos AND c.e_pos),
ret AS (SELECT *, alt_count + ref_count AS depth FROM led WHERE reason = 'retained')
"""
