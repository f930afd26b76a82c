"""Independent checks of published tables: each returns rows that break a rule, or counts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.operators import mixture as M
from tallyspan.operators import replay


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows of each side the other lacks, repeats counted."""
    right = right.select(*left.columns)
    a = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    return a.crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_right")))  # one row each


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def cluster_rules(clusters: DataFrame, mutations: DataFrame, purity: float) -> DataFrame:
    """(rule, n): broken rules of the two published tables."""
    sizes = mutations.groupBy("cluster_index").agg(F.count("*").alias("found"))
    both = clusters.join(sizes, "cluster_index", "full")
    one = both.agg(
        F.count_if(F.col("num_SNV").isNull() | F.col("found").isNull() | (F.col("num_SNV") != F.col("found"))).alias("size"),
        F.count_if((F.col("cellular_prevalence") < 0) | (F.col("cellular_prevalence") > purity)).alias("range"),
        F.count_if(F.abs(F.col("cancer_cell_fraction") * purity - F.col("cellular_prevalence")) > 1e-9).alias("fraction"),
    )
    rows = mutations.agg(
        F.count_if((F.col("multiplicity") < 1) | (F.col("multiplicity") > F.col("major_cn"))).alias("multiplicity"),
        F.count_if((F.col("expected_multiplicity") < 1 - 1e-9) | (F.col("expected_multiplicity") > F.col("major_cn") + 1e-9)).alias("expected"),
    )
    every = one.crossJoin(rows)  # one row each
    return every.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in every.columns])).alias("r")).select("r.rule", "r.n")


def _as_rules(one: DataFrame) -> DataFrame:
    """(rule, n) from one row of counts."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("r")).select("r.rule", "r.n")


def row_rules(mutations: DataFrame, clusters: DataFrame, kept: DataFrame, purity: float) -> DataFrame:
    """(rule, n): retained rows that are missing among the mutations, rows that are unknown or repeated there, rows of an unknown cluster,
    and rows whose multiplicity is not the likeliest at their cluster's fraction, as computed anew."""
    found = mutations.groupBy("original_row").agg(F.count("*").alias("times"))
    met = kept.select("original_row", F.lit(True).alias("known")).join(found, "original_row", "full")
    counts = met.agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("repeated"))
    at = mutations.select("original_row", "cluster_index", "multiplicity").join(F.broadcast(clusters.select("cluster_index", F.col("cellular_prevalence").alias("cp"))), "cluster_index", "left")
    rows = kept.select("original_row", "alt_count", "depth", "major_cn", "total_cn").join(at, "original_row")
    again = replay.accepted(rows, purity, F.coalesce("cp", F.lit(0.0)), F.col("multiplicity"))
    calls = again.agg(F.count_if(F.col("cp").isNull()).alias("cluster"), F.count_if(F.col("cp").isNotNull() & ~F.coalesce("accepted", F.lit(False))).alias("call"))
    return _as_rules(counts.crossJoin(calls))  # one row each


def order_rules(clusters: DataFrame) -> DataFrame:
    """(rule, n): cluster numbers that are not 0, 1, 2 and so on, fractions that rise, shares that are not the sizes' shares. Clusters are few."""
    w = W.orderBy("cluster_index")
    rows = clusters.select("*", (F.row_number().over(w) - 1).alias("place"), F.lag("cellular_prevalence").over(w).alias("before"), F.sum("num_SNV").over(W.partitionBy()).alias("total"))
    return _as_rules(
        rows.agg(
            F.count_if(F.col("cluster_index") != F.col("place")).alias("number"),
            F.count_if(F.col("cellular_prevalence") > F.col("before")).alias("order"),
            F.count_if(F.abs(F.col("assignment_proportion") * F.col("total") - F.col("num_SNV")) > 1e-6).alias("proportion"),
        )
    )


def center_rules(clusters: DataFrame, mutations: DataFrame, kept: DataFrame, purity: float, points: int = 129, slack: float = 1e-7) -> DataFrame:
    """(rule, n): clusters whose own rows are likelier, by over `slack` a row, at another cluster's fraction or at one of evenly spaced ones than at their own. So swapped fractions are found. Clusters are few."""
    told = {r["cluster_index"]: r["cellular_prevalence"] for r in clusters.select("cluster_index", "cellular_prevalence").collect()}
    rows = mutations.select("original_row", "cluster_index").join(kept, "original_row").groupBy("cluster_index", *M.KEY).agg(F.count("*").alias("freq"))
    sizes = rows.groupBy("cluster_index").agg(F.sum("freq").alias("n"))
    grid = sorted({k * purity / (points - 1) for k in range(points)} | {c for c in told.values() if 0 <= c <= purity})
    at = M.grid_loglik(rows, purity, grid, ("cluster_index",)).join(F.broadcast(clusters.select("cluster_index", "cellular_prevalence")), "cluster_index", "left")
    own = F.max(F.when(F.col("cp") == F.col("cellular_prevalence"), F.col("loglik"))).alias("own")
    found = at.groupBy("cluster_index").agg(F.max("loglik").alias("best"), own).join(sizes, "cluster_index")
    return found.agg(F.count_if(F.col("own").isNull() | (F.col("best") > F.col("own") + slack * F.col("n"))).alias("n")).select(F.lit("center").alias("rule"), "n")


def far_apart(left: DataFrame, right: DataFrame, keys: tuple[str, ...], slack: float = 1e-6) -> DataFrame:
    """One row, n: keys on one side only, and keys any of whose numbers differ by over `slack` of the larger, or of 1."""
    values = [c for c in left.columns if c not in keys]
    both = left.select(*keys, F.struct(*values).alias("_a")).join(right.select(*keys, F.struct(*values).alias("_b")), list(keys), "full")
    near = [F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) <= slack * F.greatest(F.lit(1.0), F.abs(F.col(f"_a.{c}")), F.abs(F.col(f"_b.{c}"))) for c in values]
    every = F.lit(True)
    for one in near:
        every = every & F.coalesce(one, F.lit(False))
    return both.agg(F.count_if(~every).alias("n"))
