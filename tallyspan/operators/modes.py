"""Extra points for a grid of fractions where single multiplicities of deep observations are narrower than its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions import likelihood as L
from tallyspan.operators.mixture import KEY
from tallyspan.plans.scratch import store

#: Points of the even grid, extra ones at most, and how many standard errors a step of the grid may hold.
POINTS, MOST, FINE = 257, 2048, 4


def narrow_counts(obs: DataFrame, purity: float, points: int = POINTS) -> DataFrame:
    """obs (one row per KEY) with first and many: the multiplicities first, first + 1, ... whose most likely fraction is inside the grid and has a standard error under a quarter of its step; and mode, that fraction times the multiplicity.

    Both fraction and error are inversely proportional to the multiplicity, so the narrow ones are those from some number on; none where no read shows the variant.
    """
    share, den = F.col("alt_count") / F.col("depth"), L.denominator(F.col("total_cn"), purity)
    error = den * F.greatest(F.sqrt(share * (1 - share) / F.col("depth")), 0.5 / F.col("depth"))
    bound = F.greatest(share * den / purity, error / F.lit(purity / (FINE * (points - 1))))
    first = F.least(F.col("major_cn") + 1, F.floor(bound) + 1).cast("long")
    many = F.when(F.col("alt_count") == 0, 0).otherwise(F.greatest(F.col("major_cn") - first + 1, F.lit(0))).cast("long")
    return obs.select(*KEY, first.alias("first"), many.alias("many"), (share * den).alias("mode"))


def narrow_modes(obs: DataFrame, purity: float, most: int = MOST, points: int = POINTS) -> DataFrame:
    """(cp): at most `most` narrow modes, each once: all of them, or those at evenly spaced places in the order of (KEY, multiplicity).

    The modes are never listed. Observations are dealt by ranges of KEY and written once; running totals of their counts address every mode, and an observation gives only those places that fall to it.
    """
    some = narrow_counts(obs, purity, points).where("many > 0")
    dealt = store(some.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "modes")
    sums = dealt.groupBy("part").agg(F.sum("many").alias("n"))  # one row per partition
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    count = dealt.agg(F.sum("many")).first()[0] or 0
    taken = min(count, most)
    upto = F.sum("many").over(W.partitionBy("part").orderBy(*KEY))
    placed = dealt.withColumn("upto", upto).join(F.broadcast(before), "part").select("*", (F.col("before") + F.col("upto") - F.col("many")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))
    # place k of the taken ones is mode k * (count - 1) div (taken - 1)
    step, gaps = max(count - 1, 1), max(taken - 1, 1)
    first, end = F.expr(f"(low * {gaps} + {step - 1}) div {step}"), F.expr(f"(high * {gaps} + {step - 1}) div {step}")
    each = placed.withColumn("k", F.explode(F.when(first < end, F.sequence(first, end - 1)))).where(F.col("k") < taken)
    return each.select((F.col("mode") / (F.col("first") + F.expr(f"k * {count - 1 if taken > 1 else 0} div {gaps}") - F.col("low"))).alias("cp")).distinct()
