"""Likelihoods of observations at cell fractions, and mixtures of fractions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions import likelihood as L

KEY = ("alt_count", "depth", "major_cn", "total_cn")


def observations(rows: DataFrame) -> DataFrame:
    """Distinct observations and how often each occurs: what follows costs by distinct row."""
    return rows.groupBy(*KEY).agg(F.count("*").alias("freq"))


def prepared(rows: DataFrame, purity: float) -> DataFrame:
    """rows with what a likelihood needs at every fraction: den and const."""
    const = L.constant(F.col("alt_count"), F.col("depth"), F.col("major_cn"))
    return rows.withColumn("den", L.denominator(F.col("total_cn"), purity)).withColumn("const", const)


def kernel(cp: Column) -> Column:
    return L.kernel(*map(F.col, ("alt_count", "depth", "major_cn", "den", "const")), cp)


def loglik(cp: Column) -> Column:
    """Log likelihood of a prepared row at cp."""
    return L.log_sum_exp(kernel(cp))


def row_loglik(rows: DataFrame, purity: float, cp: float) -> DataFrame:
    return prepared(rows, purity).select("original_row", loglik(F.lit(cp)).alias("loglik"))


def grid_loglik(obs: DataFrame, purity: float, grid: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., cp, loglik): summed log likelihood at each grid point. The grid is a literal array, so nothing is joined."""
    points = prepared(obs, purity).withColumn("cp", F.explode(F.array(*map(F.lit, grid))))
    return points.groupBy(*by, "cp").agg(F.sum(F.col("freq") * loglik(F.col("cp"))).alias("loglik"))


def best_on_grid(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best grid point of each group, the smallest if tied."""
    return scores.groupBy(*by).agg(F.max(F.struct("loglik", (-F.col("cp")).alias("back"))).alias("b")).select(*by, (-F.col("b.back")).alias("cp"), F.col("b.loglik").alias("loglik"))


def local_maxima(scores: DataFrame) -> DataFrame:
    """Grid points above the point before and not under the one after. The grid's size bounds the window."""
    w = W.orderBy("cp")
    v = F.col("loglik")
    up, down = F.lag(v).over(w), F.lead(v).over(w)
    return scores.withColumn("up", up.isNull() | (v > up)).withColumn("down", down.isNull() | (v >= down)).where("up and down").select("cp", "loglik")


def calls(rows: DataFrame, purity: float, cp: Column) -> DataFrame:
    """Per row the posterior of its multiplicity at cp: modal, expected, largest probability."""
    rows = prepared(rows, purity).withColumn("post", L.posterior(kernel(cp)))
    return rows.select("original_row", L.modal(F.col("post")).alias("multiplicity"), L.expected(F.col("post")).alias("expected_multiplicity"), F.array_max("post").alias("multiplicity_probability"))


def memberships(rows: DataFrame, purity: float, centers: list[float], weights: list[float]) -> DataFrame:
    """rows with mix, the log mixture likelihood, and member, the array of component shares. A weight of 0 has no share."""
    terms = [F.lit(-math.inf) if w <= 0 else F.lit(math.log(w)) + loglik(F.lit(c)) for c, w in zip(centers, weights, strict=True)]
    rows = prepared(rows, purity).withColumn("terms", F.array(*terms))
    return rows.withColumn("mix", L.log_sum_exp(F.col("terms"))).withColumn("member", L.posterior(F.col("terms")))


def mixture_loglik(obs: DataFrame, purity: float, centers: list[float], weights: list[float]) -> DataFrame:
    return memberships(obs, purity, centers, weights).agg(F.sum(F.col("freq") * F.col("mix")).alias("loglik"), F.sum("freq").alias("n"))


def bic(loglik_: Column, q: int | Column, n: Column) -> Column:
    return -2 * loglik_ + (2 * q - 1) * F.ln(n)


def best_component(member: Column = None) -> Column:
    """Index of the largest share, the first if tied, from 0."""
    member = F.col("member") if member is None else member
    return L.modal(member) - 1


def posterior_clusters(member: DataFrame, centers: list[float], weights: list[float], purity: float) -> DataFrame:
    """Per component: fraction, expected and assigned numbers, and what the weights would give."""
    # summed as columns: exploding the shares would compute them anew for each
    best, f = F.col("best"), F.col("freq")
    wide = member.select("freq", "member", best_component().alias("best")).agg(
        F.array(*[F.sum(f * F.col("member")[k]) for k in range(len(centers))]).alias("expected"), F.array(*[F.sum(F.when(best == k, f).otherwise(0)) for k in range(len(centers))]).alias("assigned"), F.sum(f).alias("n")
    )
    sums = wide.select("n", "assigned", F.posexplode("expected").alias("cluster_index", "expected_n")).withColumn("map_n", F.element_at("assigned", F.col("cluster_index") + 1))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster_index") + 1)
    out = sums.select(F.col("cluster_index").cast("long").alias("cluster_index"), at(centers).alias("cellular_prevalence"), (at(centers) / purity).alias("cancer_cell_fraction"), at(weights).alias("mixture_weight"), "expected_n", F.col("map_n").cast("long").alias("map_n"), (at(weights) * F.col("n")).alias("fitted_n"))
    return out


def flow(member: DataFrame, label: Column, q: int) -> DataFrame:
    """Summed shares by chain label and component; pairs without rows are 0."""
    wide = member.groupBy(label.cast("long").alias("chain_cluster_index")).agg(F.array(*[F.sum(F.col("freq") * F.col("member")[k]) for k in range(q)]).alias("s"))
    sums = wide.select("chain_cluster_index", F.posexplode("s").alias("p", "expected_n")).select("chain_cluster_index", F.col("p").cast("long").alias("posterior_cluster_index"), "expected_n")
    spark = member.sparkSession
    every = spark.range(q).select(F.col("id").alias("chain_cluster_index")).withColumn("posterior_cluster_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))))
    return every.join(sums, ["chain_cluster_index", "posterior_cluster_index"], "left").select("chain_cluster_index", "posterior_cluster_index", F.coalesce("expected_n", F.lit(0.0)).alias("expected_n"))


def summary(member: DataFrame, label: Column, centers: list[float], purity: float) -> DataFrame:
    """One row: mean entropy, mean largest share, share of rows whose label isn't their likeliest component, mean fraction."""
    ccf = L.dot(F.col("member"), F.array(*[F.lit(c / purity) for c in centers]))
    f = F.col("freq")
    mean = lambda c: F.sum(f * c) / F.sum(f)
    return member.agg(F.sum("freq").alias("n"), mean(L.entropy(F.col("member"))).alias("mean_entropy"), mean(F.array_max("member")).alias("mean_max_share"), mean((best_component() != label).cast("double")).alias("map_disagreement"), mean(ccf).alias("mean_ccf"))


def cumulative_mass(clusters: DataFrame) -> DataFrame:
    """Share of rows in components of a strictly smaller fraction. Components bound the window."""
    w = W.orderBy("cancer_cell_fraction").rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("cancer_cell_fraction")
    total = F.sum("expected_n").over(W.partitionBy())
    return clusters.select("cluster_index", "cancer_cell_fraction", ((F.sum("expected_n").over(w) - F.sum("expected_n").over(same)) / total).alias("mass_below"))


def reduced(components: DataFrame) -> DataFrame:
    """Components without those of weight 0, equal centres merged."""
    return components.where("weight > 0").groupBy("center").agg(F.sum("weight").alias("weight"))
