"""Labels that count, and bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(labels: DataFrame, label: str, keep=None) -> DataFrame:
    """(lid, y): the smallest label of each id; null labels and ids don't count. keep: a condition on the label rows' doc_id."""
    some = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("y")).where("lid is not null and y is not null")
    if keep is not None:
        some = some.where(keep(F.col("lid")))
    return some.groupBy("lid").agg(F.min("y").alias("y"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """(text, label 0/1) of at most `rows` labelled documents, chosen by a hash of their ids.

    Labels that are null, or whose id is null, don't count; of several labels of one id the smallest does. The
    sample of labels has at most `rows` rows of 12 bytes, so it is broadcast and no text is shuffled.
    keep: a condition on the label rows' doc_id, such as a hold-out rule.
    """
    some = usable(labels, label, keep).orderBy(F.xxhash64("lid"), "lid").limit(rows)
    slim = docs.select(F.col(doc_id).alias("lid"), F.col(text).alias("text"))
    return slim.join(F.broadcast(some), "lid").select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
