"""Published numbers computed a second time, from the observations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions import likelihood as L
from tallyspan.operators import mixture as M
from tallyspan.plans.ranks import ranked


def pmf_loglik(rows: DataFrame, purity: float, cp: float) -> DataFrame:
    """(original_row, loglik) from binomial probabilities built up factor by factor, without the gamma function."""
    rows = rows.withColumn("den", L.denominator(F.col("total_cn"), purity))
    rest = F.col("depth") - F.col("alt_count")
    steps = F.when(F.col("alt_count") == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("alt_count")))
    ways = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln((rest + i) / i))
    p = lambda m: F.least(F.lit(1.0), F.lit(cp) * m / F.col("den"))
    terms = F.transform(F.sequence(F.lit(1), F.col("major_cn").cast("int")), lambda m: L.xlogy(F.col("alt_count"), p(m)) + L.xlog1my(rest, p(m)))
    return rows.withColumn("ways", ways).select("original_row", (L.log_sum_exp(terms) + F.col("ways") - F.ln(F.col("major_cn").cast("double"))).alias("loglik"))


def gradients(rows: DataFrame, purity: float, cp: float, floor: float = 1e-8) -> DataFrame:
    """(original_row, loglik, gradient, curvature) at a fraction cp of 0 to the purity: the slope of the log likelihood, and the mean over multiplicities, by their shares, of each one's own negative second derivative.

    At a chance of 1 a multiplicity is impossible if any read lacks the variant, but with one such read it still has a slope from below, and an infinite curvature, and with two a curvature; both
    count with what the multiplicity would weigh without that factor. A row that is impossible altogether has slope 0 and curvature 1. By the fraction of cancer cells (cp / purity) the curvature is at least `floor`
    and that 1; here both are divided by the squared purity.
    """
    rows = M.prepared(rows, purity).withColumn("_v", M.kernel(F.lit(cp))).withColumn("loglik", L.log_sum_exp(F.col("_v"))).withColumn("_w", L.posterior(F.col("_v")))
    alt, rest, copies = F.col("alt_count"), F.col("depth") - F.col("alt_count"), F.sequence(F.lit(1), F.col("major_cn").cast("int"))
    s = lambda m: m / F.col("den")
    left = lambda m: F.when(F.lit(cp) * s(m) < 1, 1 - F.lit(cp) * s(m))  # noqa: E731  null at a chance of 1
    by = lambda power: alt / F.lit(cp**power) if cp > 0 else F.lit(0.0)  # noqa: E731  at 0 only rows without the variant are possible
    first = L.dot(F.col("_w"), F.transform(copies, lambda m: by(1) - F.coalesce(rest * s(m) / left(m), F.lit(0.0))))
    second = L.dot(F.col("_w"), F.transform(copies, lambda m: by(2) + F.coalesce(rest * s(m) * s(m) / (left(m) * left(m)), F.lit(0.0))))
    at_one = lambda power: F.aggregate(F.transform(copies, lambda m: F.when(left(m).isNull(), F.pow(s(m), F.lit(power))).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    unit = F.exp(F.col("const") - F.col("loglik"))
    gradient = first - F.when(rest == 1, unit * at_one(1)).otherwise(0.0)
    curvature = F.when((rest == 1) & (at_one(1) > 0), F.lit(math.inf)).otherwise(F.greatest(second + F.when(rest == 2, 2 * unit * at_one(2)).otherwise(0.0), F.lit(floor / purity**2)))
    possible = F.col("loglik") > -math.inf
    return rows.select("original_row", "loglik", F.when(possible, gradient).otherwise(0.0).alias("gradient"), F.when(possible, curvature).otherwise(1 / purity**2).alias("curvature"))


def accepted(rows: DataFrame, purity: float, cp: float, published: Column, slack: float = 1e-9) -> DataFrame:
    """rows with accepted: the published multiplicity is as likely as the likeliest, but for rounding."""
    rows = M.prepared(rows, purity).withColumn("_p", L.posterior(M.kernel(F.lit(cp))))
    return rows.withColumn("accepted", F.element_at("_p", published.cast("int")) >= F.array_max("_p") - slack).drop("_p")


def fit_arithmetic(member: DataFrame, weights: list[float]) -> DataFrame:
    """One row: n, log likelihood, BIC, and the gap to the best weights, n times what the largest mean score exceeds 1 by."""
    f = F.col("freq")
    sums = member.agg(F.sum(f).alias("n"), F.sum(f * F.col("mix")).alias("loglik"), F.array(*[F.sum(f * F.col("member")[k] / w) for k, w in enumerate(weights)]).alias("scores"))
    return sums.select("n", "loglik", M.bic(F.col("loglik"), len(weights), F.col("n")).alias("bic"), F.greatest(F.lit(0.0), F.array_max("scores") - F.col("n")).alias("weight_gap"))


def posterior_mutations(rows: DataFrame, label: Column, centers: list[float], weights: list[float], purity: float) -> DataFrame:
    """Per observation: its label and that label's share, the likeliest component and its share, entropy, mean fraction, mean multiplicity over all components."""
    member = M.memberships(rows, purity, centers, weights).withColumn("label", label.cast("long"))
    ccf = L.dot(F.col("member"), F.array(*[F.lit(c / purity) for c in centers]))
    means = F.array(*[L.expected(L.posterior(M.kernel(F.lit(c)))) for c in centers])
    return member.select(
        "original_row", "label", M.best_component().alias("map_index"), F.element_at("member", F.col("label").cast("int") + 1).alias("label_share"), F.array_max("member").alias("max_share"),
        L.entropy(F.col("member")).alias("entropy"), ccf.alias("expected_ccf"), L.dot(F.col("member"), means).alias("expected_multiplicity"),
    )


def allocation_distance(member: DataFrame, label: Column, q: int) -> DataFrame:
    """One row: total variation between the labels' and the components' shares of rows, and how far the components' sizes are from adding up."""
    f = F.col("freq")
    sums = member.agg(F.sum(f).alias("n"), *[F.sum(f * F.col("member")[k]).alias(f"e{k}") for k in range(q)], *[F.sum(F.when(label == k, f).otherwise(0)).alias(f"n{k}") for k in range(q)])
    total = sum((F.abs(F.col(f"e{k}") - F.col(f"n{k}")) for k in range(q)), F.lit(0.0))
    return sums.select("n", (total / 2 / F.col("n")).alias("total_variation"), F.abs(sum((F.col(f"e{k}") for k in range(q)), F.lit(0.0)) - F.col("n")).alias("count_gap"))


def sufficient(member: DataFrame, q: int) -> DataFrame:
    """(component, size, alt, rest): summed shares, and shares times reads with and without the variant."""
    f = F.col("freq")
    wide = member.agg(*[F.struct(*[F.sum(f * F.col("member")[k] * c).alias(n) for n, c in (("size", F.lit(1.0)), ("alt", F.col("alt_count")), ("rest", F.col("depth") - F.col("alt_count")))]).alias(f"c{k}") for k in range(q)])
    return wide.select(F.posexplode(F.array(*[f"c{k}" for k in range(q)])).alias("k", "s")).select(F.col("k").cast("long").alias("component"), "s.*")


def sizes(rows: DataFrame, label: Column, q: int) -> DataFrame:
    """(cluster_index, n) for 0..q-1, empty clusters with 0."""
    found = rows.groupBy(label.cast("long").alias("cluster_index")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(q).withColumnRenamed("id", "cluster_index").join(found, "cluster_index", "left").select("cluster_index", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def adjacent_merges(components: DataFrame) -> DataFrame:
    """Neighbours by falling center merged: (place, center, weight), the weighted mean and the sum. Components are few."""
    w = W.orderBy(F.col("center").desc())
    both = components.select(F.row_number().over(w).cast("long").alias("place"), "center", "weight", F.lead("center").over(w).alias("_c"), F.lead("weight").over(w).alias("_w")).where("_c is not null")
    total = F.col("weight") + F.col("_w")
    return both.select("place", ((F.col("center") * F.col("weight") + F.col("_c") * F.col("_w")) / total).alias("center"), total.alias("weight"))


def even_ranks(ranks: DataFrame, take: int) -> DataFrame:
    """`take` rows evenly spaced over the ranks, first and last included; all if there are fewer."""
    n = ranks.count()
    if n <= take:
        return ranks
    return ranks.where(F.col("rank").isin([k * (n - 1) // (take - 1) for k in range(take)])) if take > 1 else ranks.where("rank = 0")


def runs(ranks: DataFrame, holds: Column) -> DataFrame:
    """(first_rank, n) of the longest stretches of ranks for whose rows `holds` is true, each stretch once."""
    some = ranked(ranks.where(holds).select("rank"), [F.col("rank")], "_at", 0)
    return some.groupBy((F.col("rank") - F.col("_at")).alias("_run")).agg(F.min("rank").alias("first_rank"), F.count("*").alias("n")).drop("_run")


def order_check(ranks: DataFrame) -> DataFrame:
    """One row: n, and whether the ranks are 0..n-1, each once."""
    got = ranks.agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("different"))
    return got.select("n", ((F.col("n") == 0) | (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n"))).alias("valid"))


def domain_faults(rows: DataFrame, cp: Column, purity: float) -> DataFrame:
    """(fault, n) of fractions that are not finite, under 0 or over the purity."""
    low, high = math.nextafter(0, -1), math.nextafter(purity, 2)
    fault = F.when(cp.isNull() | F.isnan(cp), "not finite").when(cp <= low, "under").when(cp >= high, "over")
    return rows.select(fault.alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))
