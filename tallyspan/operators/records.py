"""Candidate records: look-ups, lineage, reconciliation and starting banks. A record has candidate_id, budget, q, bic, kind, parent_k, parent_rep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store


def where_all(rows: DataFrame, allowed: tuple[str, ...], **wanted) -> DataFrame:
    """rows that have every wanted value, a list standing for any of its values. Only allowed columns may be asked for."""
    if odd := sorted(set(wanted) - set(allowed)):
        raise ValueError(f"not to be filtered by: {', '.join(odd)}")
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items()]
    return rows.where(reduce(Column.__and__, tests, F.lit(True)))


def firsts(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the smallest candidate_id, its value, and how many records there are."""
    return rows.groupBy(by).agg(F.min("candidate_id").alias("first_id"), F.min_by(value, "candidate_id").alias(value), F.count("*").alias("n"))


def best_eligible(rows: DataFrame, eligible: Column, by: str) -> DataFrame:
    """Per group the eligible record of least (bic, q, candidate_id); groups without one are left out."""
    best = rows.where(eligible).groupBy(by).agg(F.min(F.struct("bic", "q", "candidate_id")).alias("b"))
    return best.select(by, F.col("b.candidate_id").alias("candidate_id"), F.col("b.bic").alias("bic"))


def earlier_ancestor(rows: DataFrame, family: tuple[str, ...]) -> DataFrame:
    """(candidate_id, ancestor_id): for every record that is not native the best native record of its family with a smaller id, -1 without one."""
    before = W.partitionBy(*family).orderBy("candidate_id").rowsBetween(W.unboundedPreceding, -1)
    native = F.when(F.col("kind") == "native", F.struct("bic", "candidate_id"))
    found = rows.withColumn("_a", F.min(native).over(before)).where(F.col("kind") != "native")
    return found.select("candidate_id", F.coalesce(F.col("_a.candidate_id"), F.lit(-1).cast("long")).alias("ancestor_id"))


def link_states(rows: DataFrame, previous: Column) -> DataFrame:
    """(state, n): each record against the one it names as its predecessor: root, missing, falling or rising by bic."""
    linked = rows.select(previous.alias("_p"), F.col("bic").alias("_b"), "candidate_id")
    others = rows.select(F.col("candidate_id").alias("_p"), F.col("bic").alias("_before"))
    state = F.when(F.col("_p").isNull(), "root").when(F.col("_before").isNull(), "missing").when(F.col("_b") <= F.col("_before"), "falling").otherwise("rising")
    return linked.join(others, "_p", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def disagreements(left: DataFrame, right: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row: keys on one side only, and keys whose values differ, nulls being equal."""
    other = right.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(1).alias("_r"))
    both = left.select(*keys, *values, F.lit(1).alias("_l")).join(other, list(keys), "full")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    differs = reduce(Column.__or__, [~F.col(v).eqNullSafe(F.col(f"_{v}")) for v in values])
    return both.agg(F.count_if(lone).alias("unmatched"), F.count_if(~lone & differs).alias("different"))


def mapped(proposed: DataFrame, final: DataFrame, key: str) -> DataFrame:
    """proposed with final_index, the place of its component among the final ones, -1 if it was removed."""
    return proposed.join(final, key, "left").withColumn("final_index", F.coalesce("final_index", F.lit(-1).cast("long")))


def paths(rows: DataFrame, predecessor: Column, value: Column, key: str = "candidate_id") -> DataFrame:
    """Per record what leads to it: (key, state, root, depth, falls, nearest_fall). depth counts the links back to the root, falls those on which the value is less than the predecessor's, nearest_fall the links back to
    the first of them; state is path, missing if the root names a predecessor that does not exist, or cycle, without root and numbers.

    Pointer doubling: every round joins each record's pointer with the one it points at, so a chain of n links takes log2(n) rounds, each written to the shared folder. Keys must be unique.
    """
    base = rows.select(F.col(key).alias("id"), predecessor.alias("p"), value.alias("v"))
    parent = base.select(F.col("id").alias("_id"), F.col("v").alias("_v"))
    known, falls = F.col("_id").isNotNull(), F.col("v") < F.col("_v")
    state = base.join(parent, F.col("p") == F.col("_id"), "left").select(
        "id", F.when(known, F.col("p")).otherwise(F.col("id")).alias("at"), known.cast("long").alias("depth"), F.coalesce(falls.cast("long"), F.lit(0).cast("long")).alias("falls"), F.when(falls, F.lit(1).cast("long")).alias("near"),
        (F.col("p").isNotNull() & ~known).alias("missing"), known.alias("linked"),
    )
    state = store(state, "paths")
    total, reach = state.count(), 1
    while reach < total:
        ahead = state.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("falls").alias("_falls"), F.col("near").alias("_near"))
        moved = state.join(ahead, F.col("at") == F.col("_id")).select(
            "id", F.col("_at").alias("at"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("falls") + F.col("_falls")).alias("falls"), F.coalesce("near", F.col("depth") + F.col("_near")).alias("near"), "missing", "linked", (F.col("at") != F.col("_at")).alias("moved")
        )
        state, reach = store(moved, "paths"), 2 * reach
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    roots = state.where("not linked").select(F.col("id").alias("_root"), F.col("missing").alias("_missing"))
    met, found = state.select("id", "at", "depth", "falls", "near").join(roots, F.col("at") == F.col("_root"), "left"), F.col("_root").isNotNull()
    name = F.when(~found, "cycle").when(F.col("_missing"), "missing").otherwise("path")
    return met.select(F.col("id").alias(key), name.alias("state"), F.col("_root").alias("root"), F.when(found, F.col("depth")).alias("depth"), F.when(found, F.col("falls")).alias("falls"), F.when(found, F.col("near")).alias("nearest_fall"))


#: Roles of starting states, in the order in which they are given.
ROLES = ("best_bic", "native", "best_conditional")


def starting_bank(rows: DataFrame) -> DataFrame:
    """(start_id, q, role, candidate_id): for each number of components at most one candidate a role, of all eligible ones the least BIC, the least BIC of native ones, and the largest conditional likelihood, each with a set of
    centers that no earlier role took. Ties: least BIC, then replicate, then id.

    rows: candidate_id, kind, replicate, eligible, bic, conditional, centers (array).
    """
    rows = rows.where("eligible").select("candidate_id", "kind", "replicate", "bic", "conditional", F.size("centers").cast("long").alias("q"), F.array_sort("centers").alias("same"))
    taken = None
    for k, role in enumerate(ROLES):
        left = rows.where("kind = 'native'") if role == "native" else rows
        if taken is not None:
            left = left.join(taken.select("q", "same"), ["q", "same"], "left_anti")
        first = -F.col("conditional") if role == "best_conditional" else F.col("bic")
        best = left.groupBy("q").agg(F.min(F.struct(first.alias("key"), "bic", "replicate", "candidate_id", "same")).alias("b"))
        best = best.select("q", F.lit(k).alias("_k"), F.lit(role).alias("role"), F.col("b.candidate_id").alias("candidate_id"), F.col("b.same").alias("same"))
        taken = best if taken is None else taken.unionByName(best)
    return taken.select((F.row_number().over(W.orderBy("q", "_k")) - 1).cast("long").alias("start_id"), "q", "role", "candidate_id")  # three rows a number of components


def grid_gaps(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected attempts that are missing, found ones that are not expected, and distinct found ones."""
    keys = expected.columns
    seen = found.select(*keys).distinct()
    missing = expected.join(seen, keys, "left_anti").agg(F.count("*").alias("missing"))
    return missing.crossJoin(seen.join(expected, keys, "left_anti").agg(F.count("*").alias("extra"))).crossJoin(seen.agg(F.count("*").alias("attempts")))  # one row each


def cut_faults(parents: DataFrame, low: int, high: int) -> DataFrame:
    """parents with the faults of their cuts: not rising, out of range."""
    rising = F.size("cuts") == F.size(F.array_distinct("cuts"))
    return parents.withColumn("unsorted", ~(rising & (F.col("cuts") == F.array_sort("cuts")))).withColumn("outside", F.exists("cuts", lambda c: (c < low) | (c > high)))


def digest(cuts: Column) -> Column:
    """SHA-256 of a list of cuts, spelt with commas."""
    return F.sha2(F.array_join(cuts.cast("array<string>"), ","), 256)
