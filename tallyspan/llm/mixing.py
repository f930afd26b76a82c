"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

A document's size is its number of words. Each source has a target (see targets); it is met by taking every
document `whole` times and, for what is left of the budget, once more those documents whose hash lies under a
threshold. The threshold is found without sorting documents: sizes are summed by source and leading hash bits,
the running sum over the buckets of a source shows in which bucket the budget ends, and only the documents of
that bucket are summed again by the next bits, LEVELS times. The last bucket, which as a rule holds one
document, is taken if that brings the source nearer to its target.

Sizes of null and empty texts are 0. Null is a source of its own, the last. The hash is of the id and, below that, of the text, so rows that
share an id (null included) are told apart by their texts, rows alike in both share one decision, and reruns agree. An empty table has no sources. Texts of any length
are counted whole. Extra columns of the input, of any type and name, are kept by mixed() and not looked at elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each histogram splits by, and how many histograms follow one another.
LEVEL_BITS, LEVELS = 12, 5
#: Hexadecimal digits of the hash that come from the id, and from the text.
ID_DIGITS, TEXT_DIGITS = 9, 6
MOST_TIMES = 3


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column, seed: str = "") -> Column:
    """60 bits: 36 of the id's MD5, then 24 of the text's; null counts as empty. Any engine can compute it."""
    digits = lambda c, n: F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(c.cast("string"), F.lit("")))), 1, n)
    return F.conv(F.concat(digits(doc_id, ID_DIGITS), digits(text, TEXT_DIGITS)), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh `weights`, repeated. All sizes are shared by weight, but a target stops
    at `most` times its source's size and the excess is shared again: with sources in order of cap by weight, a
    source is capped if the share that is left for it by those before it reaches its cap.
    """
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("capped", F.col("cap") * shares <= F.col("weight") * left)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    open_ = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * rest).cast("double") / open_)
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, under, last): documents of a source whose hash is under `under` fit its budget; the bucket from there to `last`, taken too, is nearer to it.

    slim: (source, size, h), h of LEVELS * LEVEL_BITS bits; budgets: (source, budget).
    """
    total = LEVEL_BITS * LEVELS
    at = slim.select("source", "size", "h")
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(True).alias("open"), F.lit(0).cast("long").alias("crossing"))
    for level in range(1, LEVELS + 1):
        shift = total - level * LEVEL_BITS
        # the state has one row per source, whose number bounds it; Spark broadcasts it if small
        here = at.withColumn("bucket", F.shiftright("h", shift))
        if level > 1:
            edge = state.where("open").select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            here = here.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("p")), "left_semi")
        sums = here.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bucket")))
        told = running.join(state.where("open").select(F.col("source").alias("s"), "budget"), F.col("source").eqNullSafe(F.col("s")))
        crossed = told.where("upto > budget").groupBy("source").agg(F.min_by(F.struct("bucket", "n", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("c"))
        crossed = crossed.select(F.col("source").alias("s"), "c")
        state = state.join(crossed, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            F.when(F.col("c").isNotNull(), F.col("budget") - F.col("c.before")).otherwise(F.col("budget")).alias("budget"),
            F.when(F.col("c").isNotNull(), F.col("c.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            (F.col("open") & F.col("c").isNotNull()).alias("open"),
            F.coalesce(F.col("c.n"), F.lit(0).cast("long")).alias("crossing"),
        )
        state = store(state, "thresholds")  # so that a level's plan does not hold the levels before
    # a source that never crossed has a budget over what its documents sum to: all are taken
    end = F.lit(1 << total).cast("long")
    nearer = F.col("crossing") - F.col("budget") < F.col("budget")
    return state.select("source", F.when(F.col("open"), F.col("prefix") + F.when(nearer, 1).otherwise(0)).otherwise(end).alias("under"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """(source, source_size, target, whole, under): how often every document of a source is taken, and under which hash once more."""
    slim = store(docs.select(F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(doc_id), F.col(text), seed).alias("h")), "sizes")
    aims = store(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("whole", whole)
    under = thresholds(slim, aims.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    under = under.select(F.col("source").alias("s"), "under")
    return store(aims.join(under, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")


def _times(h: Column) -> Column:
    return F.when(F.col("source_size") > 0, F.col("whole") + F.when(h < F.col("under"), 1).otherwise(0)).otherwise(0)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """One row per row of docs: size, source_size, target, taken (words, repeats counted)."""
    found = plan(docs, doc_id, text, source, weights, seed).withColumnRenamed("source", "s")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("src"), size_of(F.col(text)).alias("size"), hash_of(F.col(doc_id), F.col(text), seed).alias("h"))
    rows = rows.join(found, F.col("src").eqNullSafe(F.col("s")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("h"))).cast("long").alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with all their columns."""
    found = plan(docs, doc_id, text, source, weights, seed).select(F.struct("source", "source_size", "whole", "under").alias("_plan"))
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_row"))
    own = lambda c: F.col("_row")[c]
    rows = rows.join(found, own(source).cast("string").eqNullSafe(F.col("_plan.source")))
    rows = rows.select("_row", "_plan.*").withColumn("_times", _times(hash_of(own(doc_id), own(text), seed)))
    return rows.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy")).select("_row.*")


ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM slim GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS shares FROM src),
cum AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, cap * (shares - weight_before) <= weight * (total - cap_before) AS capped FROM cum),
aims AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (weight * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::BIGINT::DOUBLE / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::BIGINT END AS target
  FROM marked),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims),
runs AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM slim s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT
            ELSE (size * (whole + CASE WHEN upto <= budget OR upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END))::BIGINT END AS taken
FROM runs
"""
