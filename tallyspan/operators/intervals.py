"""Points joined to the non-overlapping interval that holds them, and checks of the intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions per bucket of the join. A segment is copied once for each bucket that it touches.
BUCKET = 1 << 16


def joined(points: DataFrame, segments: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """points with the columns of the segment (chrom, s_pos, e_pos, ends included) that holds pos; nulls where none does.

    An equality join on chromosome and coordinate bucket, so the work spreads over as many tasks as there are buckets, not
    chromosomes, and a point meets the few segments of its bucket only.
    """
    cut = segments.withColumnRenamed("chrom", "_chrom").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("s_pos") / bucket), F.floor(F.col("e_pos") / bucket))))
    at = (F.col("chrom") == F.col("_chrom")) & (F.floor(F.col("pos") / bucket) == F.col("_bucket")) & F.col("pos").between(F.col("s_pos"), F.col("e_pos"))
    return points.join(cut, at, "left").drop("_chrom", "_bucket")


def joined_in_order(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The same rows from one ordered pass a chromosome: the last segment that starts at or before the point, if it also ends at or after it.

    One shuffle and no copies, but no more tasks than chromosomes.
    """
    names = [c for c in segments.columns if c != "chrom"]
    held = F.struct(*names)
    both = points.select("chrom", F.col("pos").alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(segments.select(held.alias("s")).schema["s"].dataType).alias("_s"))
    marks = segments.select("chrom", F.col("s_pos").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("_p"), held.alias("_s"))
    last = F.last("_s", ignorenulls=True).over(W.partitionBy("chrom").orderBy("_at", "_kind"))
    found = both.unionByName(marks).withColumn("_s", last).where("_kind = 1")
    return found.select("_p.*", *[F.when(F.col("_s.e_pos") >= F.col("_at"), F.col(f"_s.{n}")).alias(n) for n in names])


def overlaps(segments: DataFrame) -> DataFrame:
    """The segments that start at or before the largest end of those before them, with that end."""
    before = W.partitionBy("chrom").orderBy("s_pos", "e_pos", "segment_id").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("before", F.max("e_pos").over(before)).where("s_pos <= before")
