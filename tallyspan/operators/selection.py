"""Candidate partitions: coarsenings of parents, their ranking, and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Cuts of a parent at most: each doubles its coarsenings.
MOST_CUTS = 16


def coarsenings(parents: DataFrame, budgets: list[int]) -> DataFrame:
    """Parents and all partitions that merging neighbouring blocks of theirs gives: (budget, cuts, parent_k, parent_rep, kind), one row per budget and cuts.

    parents: requested_k, replicate, cuts (sorted array of at most MOST_CUTS). A parent goes to the budget that it was requested for, as `native`, and to its own number of blocks, as
    `capacity_reuse`; each coarsening goes to its number of blocks, as `adjacent_coarsening`. A cut set of several routes to a budget has the first by (native before others, parent_k, parent_rep, kind).
    """
    wide = F.when(F.size("cuts") > MOST_CUTS, F.raise_error(F.lit(f"a parent has more than {MOST_CUTS} cuts"))).otherwise(F.expr("sequence(0, shiftleft(1, size(cuts)) - 1)"))
    masks = parents.withColumn("mask", F.explode(wide))
    picked = masks.withColumn("picked", F.expr("filter(cuts, (c, i) -> shiftright(mask, i) % 2 = 1)"))
    blocks = (F.size("picked") + 1).cast("long")
    whole = F.size("picked") == F.size("cuts")
    route = lambda budget, kind: F.struct(budget.alias("budget"), F.lit(kind).alias("kind"))
    routes = F.when(whole, F.array(route(F.col("requested_k").cast("long"), "native"), route(blocks, "capacity_reuse"))).otherwise(F.array(route(blocks, "adjacent_coarsening")))
    ways = picked.select("picked", "requested_k", "replicate", F.explode(routes).alias("way")).where(F.col("way.budget").isin(*budgets))
    owner = F.struct((F.col("way.kind") != "native").alias("derived"), F.col("requested_k").alias("parent_k"), F.col("replicate").alias("parent_rep"), F.col("way.kind").alias("kind"))
    best = ways.groupBy(F.col("way.budget").alias("budget"), F.col("picked").alias("cuts")).agg(F.min(owner).alias("owner"))
    return best.select("budget", "cuts", F.col("owner.parent_k").alias("parent_k"), F.col("owner.parent_rep").alias("parent_rep"), F.col("owner.kind").alias("kind"))


def contained(small: Column, large: Column) -> Column:
    """Whether all elements of one array are in the other."""
    return F.size(F.array_except(small, large)) == 0


def winners(candidates: DataFrame) -> DataFrame:
    """Per budget the candidate of least (bic, q, derived, parent_k, parent_rep, candidate_id)."""
    key = F.struct("bic", "q", (F.col("kind") != "native").alias("derived"), "parent_k", "parent_rep", "candidate_id")
    return candidates.groupBy("budget").agg(F.min(key).alias("w")).select("budget", F.col("w.candidate_id").alias("candidate_id"), F.col("w.bic").alias("bic"), F.col("w.q").alias("q"))


def flagged(candidates: DataFrame, won: DataFrame) -> DataFrame:
    """candidates with is_budget_winner and is_winner, the best of all budgets by (bic, q, budget)."""
    best = won.agg(F.min(F.struct("bic", "q", "budget", "candidate_id")).alias("b")).select(F.col("b.candidate_id").alias("best_id"))
    per = won.select(F.col("candidate_id").alias("won_id"))
    marked = candidates.join(per, F.col("candidate_id") == F.col("won_id"), "left").join(best, F.col("candidate_id") == F.col("best_id"), "left")
    return marked.withColumn("is_budget_winner", F.col("won_id").isNotNull()).withColumn("is_winner", F.col("best_id").isNotNull()).drop("won_id", "best_id")


def quotas(rows: DataFrame, value: Column, bins: int, take: int) -> DataFrame:
    """Per bin of equal width over (0, 1]: its rows, quota, and whole rows to take by largest remainder, ties to the lower bin."""
    bin_ = F.greatest(F.ceil(value * bins), F.lit(1)).cast("long")
    counts = rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    quota = F.col("n") * F.lit(take) / F.sum("n").over(W.partitionBy())
    parts = counts.withColumn("quota", quota).withColumn("base", F.floor("quota").cast("long"))
    left = F.lit(take) - F.sum("base").over(W.partitionBy())
    place = F.row_number().over(W.orderBy((F.col("quota") - F.col("base")).desc(), "bin"))
    return parts.withColumn("take", F.least("n", F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long")).select("bin", "n", "take")


def sampled(rows: DataFrame, value: Column, bins: int, take: int, seed: int, key: str = "original_row") -> DataFrame:
    """quotas() many rows of each bin, those of least MD5 of seed and key; rows that share a key are told apart by nothing.

    A histogram of each bin's digests over 4096 buckets finds the bucket in which its quota ends. Buckets before it are taken whole, and only
    that bucket's rows are put in order, so a bin of any size is never sorted in one task.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    dealt = rows.withColumn("bin", F.greatest(F.ceil(value * bins), F.lit(1)).cast("long")).withColumn("_h", digest).withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = dealt.groupBy("bin", "_bucket").agg(F.count("*").alias("_n"))
    upto = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("bin").orderBy("_bucket")) - F.col("_n"))
    ends = upto.join(F.broadcast(quotas(rows, value, bins, take).select("bin", "take")), "bin")  # one row per bin
    last = ends.where("_before < take").groupBy("bin").agg(F.max(F.struct("_bucket", (F.col("take") - F.col("_before")).alias("need"))).alias("_end"))
    met = dealt.join(F.broadcast(last), "bin")
    whole = met.where("_bucket < _end._bucket")
    part = met.where("_bucket = _end._bucket").withColumn("_place", F.row_number().over(W.partitionBy("bin").orderBy("_h", key))).where("_place <= _end.need")
    return whole.unionByName(part.drop("_place")).drop("_h", "_bucket", "_end")


def window_of(value: Column, window: float, overlap: float) -> Column:
    """The first of the windows that covers a value of 0 to 1, from 0. Windows are `window` wide, each begins `overlap` before the end of the one before, and the last ones end at 1."""
    step = window - overlap
    near = F.greatest(F.floor((value - window) / step) - 1, F.lit(0)).cast("long")  # rounding puts it one off at most
    end = lambda k: F.least(F.lit(1.0), F.lit(window) + k * F.lit(step))
    return F.when(end(near) >= value, near).when(end(near + 1) >= value, near + 1).when(end(near + 2) >= value, near + 2).otherwise(near + 3)


def window_quotas(rows: DataFrame, value: Column, size: int, window: float, overlap: float) -> DataFrame:
    """Per window: its rows, and how many of them a sample of `size` takes, in proportion and by largest remainder, ties to the lower window. As many as there are rows, if size is larger."""
    counts = rows.groupBy(window_of(value, window, overlap).alias("bin")).agg(F.count("*").alias("n"))  # windows bound it
    every = F.sum("n").over(W.partitionBy())
    quota = F.col("n") * F.least(F.lit(size), every) / every
    parts = counts.withColumn("quota", quota).withColumn("base", F.floor("quota").cast("long")).withColumn("left", F.least(F.lit(size), every) - F.sum("base").over(W.partitionBy()))
    place = F.row_number().over(W.orderBy((F.col("quota") - F.col("base")).desc(), "bin"))
    return parts.select("bin", "n", (F.col("base") + F.when(place <= F.col("left"), 1).otherwise(0)).cast("long").alias("take"))


def window_samples(rows: DataFrame, value: Column, size: int, seed: int, replicates: int, window: float, overlap: float, key: str = "original_row") -> DataFrame:
    """rows with replicate (from 1) and bin: for each replicate window_quotas() many rows of each window, those of least MD5 of seed + replicate and key. All replicates are drawn together.

    As in sampled(), a histogram of digests finds the bucket in which a window's quota ends, and only that bucket is put in order. rows are read four times, so store them if they take work.
    """
    dealt = rows.withColumn("bin", window_of(value, window, overlap)).withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    dealt = dealt.withColumn("_h", F.md5(F.concat((F.lit(seed) + F.col("replicate")).cast("string"), F.lit(":"), F.col(key).cast("string")))).withColumn("_bucket", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = dealt.groupBy("replicate", "bin", "_bucket").agg(F.count("*").alias("_n"))
    upto = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy("replicate", "bin").orderBy("_bucket")) - F.col("_n"))
    ends = upto.join(window_quotas(rows, value, size, window, overlap).select("bin", "take"), "bin")
    last = ends.where("_before < take").groupBy("replicate", "bin").agg(F.max(F.struct("_bucket", (F.col("take") - F.col("_before")).alias("need"))).alias("_end"))
    met = dealt.join(F.broadcast(last), ["replicate", "bin"])  # one row per replicate and window, so that no row is shuffled for it
    whole = met.where("_bucket < _end._bucket")
    part = met.where("_bucket = _end._bucket").withColumn("_place", F.row_number().over(W.partitionBy("replicate", "bin").orderBy("_h", key))).where("_place <= _end.need")
    return whole.unionByName(part.drop("_place")).drop("_h", "_bucket", "_end")


def boundaries(sample: DataFrame, *by: str) -> DataFrame:
    """Cuts of the full chain from blocks of a sample of it (rank, block), for each value of `by`: halfway between neighbours of different blocks, rounded down, plus 1."""
    ends = sample.groupBy(*by, "block").agg(F.min("rank").alias("low"), F.max("rank").alias("high"))
    after = F.lead("low").over(W.partitionBy(*by).orderBy("block"))  # one row per block
    return ends.withColumn("after", after).where("after is not null").select(*by, "block", (F.floor((F.col("high") + F.col("after")) / 2) + 1).cast("long").alias("cut"))


def united(*points: DataFrame) -> DataFrame:
    """All points of several one-column tables, each once."""
    return reduce(DataFrame.unionByName, points).distinct()
