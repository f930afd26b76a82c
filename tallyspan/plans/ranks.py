"""Global row numbers without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store


#: Bits of monotonically_increasing_id() that number the rows of a partition.
ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank", start: int = 1, keep: list[str] | None = None) -> DataFrame:
    """df with its place in `order`, from `start` on. Ties fall anywhere, so give a total order. Names in `order` are df's own columns, which are dealt without a copy. keep: columns of the result, all if not given.

    Rows are dealt by range, sorted and numbered within their partitions, and written once, as another evaluation could deal them otherwise; a row's place
    is its number after what the partitions before its own hold. They are shuffled once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c if isinstance(c, str) else f"_k{i}" for i, c in enumerate(order)]
    own = {k: c for c, k in zip(order, keys, strict=True) if not isinstance(c, str)}
    dealt = df.select("*", *[c.alias(k) for k, c in own.items()]).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = store(dealt.drop(*own) if keep is None else dealt.select(*keep, "_at"), "ranked")
    part = F.shiftright("_at", ROW_BITS)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + start
    return dealt.join(F.broadcast(before), part == F.col("_part")).withColumn(name, place.cast("long")).drop("_part", "_at", "_before")
