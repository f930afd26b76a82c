"""A stream of observations classified against fixed segments. An addition of this library: a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspan.operators import ledger


def classified(points: DataFrame, segments: DataFrame) -> DataFrame:
    """ledger() of a stream: each observation leaves as soon as it comes, as no state is kept."""
    return ledger.ledger(points, segments)


def counts_by_time(rows: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Reasons counted by windows of `width` of a time column; rows later than `late` are dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "reason").agg(F.count("*").alias("n"))


def to_parquet(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet, exactly once; checkpoint is a folder that all share."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
