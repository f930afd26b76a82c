"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.llm.hot import with_hubs
from tallyspan.plans.scratch import remove, store, stored

#: Links that a task contracts among themselves, about: 1 MB.
PART = 1 << 16


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Per node 0..n-1 the smallest node that the links u-v reach."""
    at = np.arange(n)
    while True:
        old, a, b = at.copy(), at[u], at[v]
        low = np.minimum(a, b)
        np.minimum.at(at, a, low)
        np.minimum.at(at, b, low)
        while ((up := at[at]) != at).any():
            at = up
        if (at == old).all():
            return at


def _contracted(part: int):
    """Runs over links of longs: each node with the smallest that the links at hand reach. At hand are those of a task, if no more than `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in some]) for k in (0, 1))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(at[: len(u)], at[len(u) :], len(nodes))])], names=["u", "v"])

        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n > part:
                yield made(some)
                some, n = [], 0
        if n:
            yield made(some)

    return run


def _handed_on(links: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m, the smallest v of u. A hub's links are summed up before the shuffle and then stay where they are."""
    minima = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return with_hubs(links, minima, "u", "n", total).drop("n")


def components(links: DataFrame, most_rounds: int = 60, part: int = PART) -> DataFrame:
    """(node, component) for every node of links (a, b), component being its smallest node.

    Links of longs are first contracted part by part, in as many tasks as parts of `part` links need, again while that halves them. What
    is one part then is done; parts that share nodes are joined by star contraction: in turn, each node hands its larger and then its smaller neighbours to the smallest node
    around it, until every component is a star: no node has two smaller neighbours, and none both a smaller and a larger one. Each round is
    written to the shared folder and the round before is deleted. Nodes may be of any type with an order and must not be null. Links of a node
    to itself are allowed, an empty table has no components.
    """
    spark, pairs = links.sparkSession, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    whole = all(f.dataType == T.LongType() for f in pairs.schema)
    all_links, made = stored(pairs if whole else pairs.distinct(), "links")
    before = all_links.count() if whole else 0
    while whole:
        parts = max(1, -(-before // part))
        all_links, path = stored(all_links.coalesce(parts).mapInArrow(_contracted(part), "u long, v long"), "links")
        remove(spark, made)
        if parts == 1:
            return all_links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        made, total = path, all_links.count()
        whole, before = 2 * total <= before, total
    loops, now = all_links.where("u = v").select("u"), all_links.where("u > v")
    total, old = now.count(), None
    for _ in range(most_rounds if total else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _handed_on(both, 2 * total).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large, path = stored(large, "links")
        if old:
            remove(spark, old)
        total = large.count()
        small = _handed_on(large, total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        now, old = stored(small, "links")
        remove(spark, path)
        total = now.count()
        # per node how many smaller neighbours it has, plus 2 if it has a larger one: a star has 1 and 2 only
        sides = now.select(F.col("u").alias("x"), F.lit(1).alias("k")).unionByName(now.select(F.col("v").alias("x")).distinct().withColumn("k", F.lit(2)))
        if sides.groupBy("x").agg(F.sum("k").alias("k")).where("k > 2").isEmpty():
            break
    else:
        if total:
            raise RuntimeError("components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return store(found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "components")
