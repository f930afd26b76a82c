"""The fit's own operators against brute force: ordered partitions, block centres, coarsenings, samples, and published labels whose centres cross."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.operators import chain as C
from tallyspan.operators import checks
from tallyspan.operators import mixture as M
from tallyspan.operators import modes
from tallyspan.operators import selection as S
from tallyspan.plans import blocks as B
from tallyspan.plans import fit as P


def brute_partition(v):
    n, q = v.shape
    best = (-math.inf, None)
    for cuts in combinations(range(1, n), q - 1):
        e = [0, *cuts, n]
        total = sum(v[e[b] : e[b + 1], b].sum() for b in range(q))
        if total > best[0]:
            best = (total, list(cuts))
    return best


def test_runs_against_all_cuts():
    """Runs of any lengths, read in batches, chained as the driver does it; impossible rows and ties."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, q = rng.integers(1, 10), rng.integers(1, 5)
        v = rng.integers(-4, 5, (n, q)).astype(float)
        v[rng.random((n, q)) < rng.choice([0, 0.15, 0.4])] = -np.inf
        edges, state = sorted({0, int(n), *rng.integers(0, n + 1, 3).tolist()}), None
        for lo, hi in zip(edges, edges[1:], strict=False):
            run = C._Run(q, lo == 0)
            for x in range(lo, hi, 3):
                run.extend(np.arange(x, min(hi, x + 3)), v[x : min(hi, x + 3)], x == lo)
            if state is None:
                state = [(run.value[0, b], run.starts[0][b]) for b in range(q)]
                continue
            paths = [[(state[a][0] + run.value[a + 1, b], a) for a in range(q)] for b in range(q)]
            state = [(max(p)[0], (*state[max(p)[1]][1], *run.starts[max(p)[1] + 1][b])) if max(p)[0] > -np.inf else (-np.inf, ()) for b, p in enumerate(paths)]
        want = brute_partition(v)[0] if n >= q else -np.inf
        assert state[q - 1][0] == want
        if want > -np.inf:
            e = [*state[q - 1][1], n]
            assert e[0] == 0 and len(e) == q + 1 and all(a < b for a, b in zip(e, e[1:], strict=False)) and sum(v[e[b] : e[b + 1], b].sum() for b in range(q)) == want


@pytest.mark.parametrize("rows", [1 << 20, 3])
def test_ordered_partitions(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "RANGE_ROWS", rows)
    monkeypatch.setattr(C.in_ranges, "__defaults__", (rows,))
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((12, 5)), 3)
    v[2, 0] = v[5, 1] = v[11, 0] = v[0, 1] = v[3, 4] = -np.inf
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "rank long, v array<double>").repartition(3)
    (a, cuts_a), (b, cuts_b) = C.ordered_partitions(df, F.col("v"), [3, 2])
    assert (a, cuts_a) == (pytest.approx(brute_partition(v[:, :3])[0]), brute_partition(v[:, :3])[1])
    assert (b, cuts_b) == (pytest.approx(brute_partition(v[:, 3:])[0]), brute_partition(v[:, 3:])[1])
    with pytest.raises(ValueError, match="finite total"):
        C.ordered_partitions(df.where("rank < 2"), F.col("v"), [3, 2])
    never = F.transform("v", lambda x: F.when(F.col("rank") == 4, F.lit(-math.inf)).otherwise(x))
    with pytest.raises(ValueError, match="finite total"):
        C.ordered_partitions(df, never, [3, 2])
    with pytest.raises(ValueError, match="without gaps"):
        C.ordered_partitions(df.where("rank <> 4"), F.col("v"), [3, 2])


def test_derivatives_and_bounds():
    rng = np.random.default_rng(0)
    alt = rng.integers(0, 40, 100)
    rows = (alt, alt + rng.integers(0, 40, 100) + 1, rng.integers(1, 5, 100), rng.uniform(5, 8, 100), rng.normal(size=100))
    at, e = np.array([0.1, 0.5, 0.89]), 1e-5
    value, slope, bend = B.curves(*rows, at)
    up, down = B.curves(*rows, at + e), B.curves(*rows, at - e)
    assert np.allclose((up[0] - down[0]) / 2 / e, slope, rtol=1e-6, atol=1e-4) and np.allclose((up[1] - down[1]) / 2 / e, bend, rtol=1e-6, atol=1e-3)
    assert np.allclose(value, P.logliks(*rows, at))
    grid, fine = np.linspace(0, 0.9, 31), np.linspace(0, 0.9, 3001)
    most, told = B.ceilings(*rows, grid), B.value_of(*rows, fine)
    for c in range(30):
        assert (told[:, (fine >= grid[c]) & (fine <= grid[c + 1])].max(axis=1) <= most[:, c] + 1e-9).all()


def chain_of(spark, obs, purity):
    """obs: alt, depth, major, total, freq in chain order."""
    df = spark.createDataFrame([(k, *map(int, o), k / 1000) for k, o in enumerate(obs)], "rank long, alt_count long, depth long, major_cn long, total_cn long, freq long, pilot double")
    return M.prepared(df, purity)


@pytest.mark.parametrize("n, depth, majors", [(1, 1_000_000, 12), (6, 1_000_000, 6), (40, 3000, 6), (2, 30, 2)])
def test_refit_is_never_beaten_by_a_dense_grid(spark, n, depth, majors):
    """Narrow, deep blocks with many multiplicities: by under 1e-10 a row."""
    rng = np.random.default_rng(n)
    major = rng.integers(1, majors + 1, n)
    total, d = major + rng.integers(0, 2, n), rng.integers(1, depth, n) + 1
    den = 0.2 + 0.9 * total
    alt = rng.binomial(d, np.minimum(1, rng.uniform(0.05, 0.9) * np.array([rng.integers(1, m + 1) for m in major]) / den))
    chain = chain_of(spark, list(zip(alt, d, major, total, rng.integers(1, 4, n), strict=True)), 0.9).repartition(3)
    rows = chain.orderBy("rank").toPandas()
    spans = [(0, n)] + ([(0, n // 2), (n // 2, n)] if n > 1 else [])
    for (i, j), x, v, size in zip(spans, *B.refit(chain, 0.9, spans, surely=True), strict=True):
        part = rows.iloc[i:j]
        columns = [part[c].to_numpy() for c in P.NEEDED]
        dense = np.unique(np.concatenate([np.linspace(0, 0.9, 20001), *[np.clip(alt[i:j] / d[i:j] * den[i:j] / m, 0, 0.9) for m in range(1, majors + 1)], np.clip(x + np.linspace(-1, 1, 2001) * 1e-4, 0, 0.9)]))
        told = part["freq"].to_numpy() @ P.logliks(*columns, dense)
        assert told.max() - v < 1e-10 * size and size == part["freq"].sum()
        assert abs(part["freq"].to_numpy() @ P.logliks(*columns, np.array([x]))[:, 0] - v) < 1e-9 * max(1, abs(v))


def test_search_against_all_coarsenings(spark):
    """Every coarsening of every parent scored; the winners are those of a plain computation; centres that cross keep their blocks."""
    rng = np.random.default_rng(5)
    truth = [0.2, 0.8, 0.45, 0.8]  # along the chain, so centres cross and repeat
    obs = [(rng.binomial(60, c / 2), 60, 1, 2, 1) for c in truth for _ in range(12)]
    chain = chain_of(spark, obs, 0.9)
    n = len(obs)
    parents = [(4, 1, [12, 24, 36]), (3, 1, [10, 24]), (5, 2, [12, 24, 36])]
    found, candidates = P.search(chain, 0.9, n, parents, [1, 2, 3, 4, 5])
    rows = candidates.collect()
    cuts = {(): 1} | {c: 1 for k in (1, 2, 3) for c in combinations((12, 24, 36), k)} | {(10,): 1, (10, 24): 1}
    assert {tuple(r["cuts"]) for r in rows} == set(cuts)
    kinds = {(r["budget"], tuple(r["cuts"])): (r["kind"], r["parent_k"], r["parent_rep"]) for r in rows if r["kind"] != "repaired"}
    assert kinds[(4, (12, 24, 36))] == ("native", 4, 1) and kinds[(5, (12, 24, 36))] == ("native", 5, 2) and kinds[(3, (10, 24))] == ("native", 3, 1) and kinds[(2, (24,))] == ("adjacent_coarsening", 3, 1)
    pdf = chain.orderBy("rank").toPandas()
    like = P.logliks(*(pdf[c].to_numpy() for c in P.NEEDED), np.linspace(0, 0.9, 9001))
    for r in rows:
        best = sum(like[i:j].sum(axis=0).max() for i, j in zip([0, *r["cuts"]], [*r["cuts"], n], strict=True))
        assert r["conditional"] == pytest.approx(best, abs=1e-4) and r["conditional"] >= best - 1e-9
    for f in found:
        able = [(r["bic"], r["q"]) for r in rows if r["budget"] == f.requested and r["eligible"]]
        assert (f.bic, f.k) == (pytest.approx(min(able)[0], abs=1e-3), min(able)[1]) and f.weights[-1] > 0
        assert f.centers == sorted(f.centers, reverse=True) and sorted(f.labels) == list(range(f.k))
    four = next(f for f in found if f.requested == 4)
    ends = list(zip([0, *four.cuts], [*four.cuts, n], strict=True))
    for b, (i, j) in enumerate(ends):
        assert four.centers[four.labels[b]] == pytest.approx(np.linspace(0, 0.9, 9001)[like[i:j].sum(axis=0).argmax()], abs=2e-4)
    assert sum(r["is_winner"] for r in rows) == 1 and sum(r["is_budget_winner"] for r in rows) == 5


def test_published_labels_where_centres_cross(spark):
    rng = np.random.default_rng(2)
    truth = [0.3, 0.7, 0.5]
    obs = [(int(rng.binomial(400 + 30 * b + k, c / 2)), b) for b, c in enumerate(truth) for k in range(30)]
    rows = spark.createDataFrame([(k, f"m{k}", 1, k, o[0], 400 + k, 1, 2) for k, o in enumerate(obs)], "original_row long, mutation_id string, chrom long, pos long, alt_count long, depth long, major_cn long, total_cn long")
    chain = M.prepared(M.observations(rows), 0.9).join(rows.select(*M.KEY, F.col("original_row").alias("rank")), list(M.KEY)).withColumn("pilot", F.col("rank") / 1000)
    cuts = [sum(o[1] < b for o in obs) for b in (1, 2)]
    fit = P.scored(chain, 0.9, len(obs), [cuts])[0]
    assert fit.labels == [2, 0, 1]
    tables = P.tables(rows, chain, fit, 0.9)
    got = {r["original_row"]: r["cluster_index"] for r in tables["mutations"].collect()}
    assert all(got[k] == fit.labels[o[1]] for k, o in enumerate(obs))
    clusters = {r["cluster_index"]: r for r in tables["clusters"].collect()}
    assert [clusters[k]["cellular_prevalence"] for k in range(3)] == pytest.approx([0.7, 0.5, 0.3], abs=0.03) and [clusters[k]["num_SNV"] for k in range(3)] == [30, 30, 30]
    flow = {(r["chain_cluster_index"], r["posterior_cluster_index"]): r["expected_n"] for r in P.posterior_tables(rows, chain, fit, 0.9)["posterior_flow"].collect()}
    assert all(flow[k, k] > 20 for k in range(3))
    count = lambda c, m: checks.center_rules(c, m, rows, 0.9).first()["n"]
    assert count(tables["clusters"], tables["mutations"]) == 0
    swapped = tables["mutations"].withColumn("cluster_index", F.when(F.col("cluster_index") < 2, 1 - F.col("cluster_index")).otherwise(2))
    assert count(tables["clusters"], swapped) == 2  # the very fault: rows with another block's centre


def test_equal_neighbours_are_merged():
    assert P.merged([3, 5, 9], [0.2, 0.2, 0.4, 0.2], [-1.0, -2.0, -3.0, -4.0], [3, 2, 4, 1]) == ([5, 9], [0.2, 0.4, 0.2], [-3.0, -3.0, -4.0], [5, 4, 1])
    assert P.falling([0.2, 0.5, 0.2]) == ([1, 0, 2], [1, 0, 2]) and P.falling([0.1, 0.3, 0.3]) == ([1, 2, 0], [2, 0, 1])


@pytest.mark.parametrize("window, overlap", [(0.1, 0.0), (0.1, 0.04), (0.25, 0.2), (1.0, 0.0), (0.3, 0.1)])
def test_windows_and_quotas(spark, window, overlap):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.random(400), np.arange(11) / 10, np.repeat(0.05, 200)])
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "original_row long, v double").repartition(3)
    ends = np.minimum(np.array([window + k * (window - overlap) for k in range(40)]), 1.0)
    bins = np.searchsorted(ends, values, side="left")
    assert {r["original_row"]: r["b"] for r in rows.select("original_row", S.window_of(F.col("v"), window, overlap).alias("b")).collect()} == dict(enumerate(bins))
    for size in (50, 611, 9999):
        took = {r["bin"]: r["take"] for r in S.window_quotas(rows, F.col("v"), size, window, overlap).collect()}
        names, n = np.unique(bins, return_counts=True)
        quota = n * min(size, len(values)) / len(values)
        take = np.floor(quota).astype(int)
        take[np.argsort(-(quota - take), kind="stable")[: min(size, len(values)) - take.sum()]] += 1
        assert took == dict(zip(names, take, strict=True))
    drawn = S.window_samples(rows, F.col("v"), 50, 3, 3, window, overlap).collect()
    assert sorted({r["replicate"] for r in drawn}) == [1, 2, 3] and len(drawn) == 150 and len({(r["replicate"], r["original_row"]) for r in drawn}) == 150
    assert len({frozenset(r["original_row"] for r in drawn if r["replicate"] == k) for k in (1, 2, 3)}) == 3


def test_sample_boundaries_are_midpoints(spark):
    sample = spark.createDataFrame([(r, b, rep) for rep, some in ((1, [(2, 0), (5, 0), (8, 1), (30, 2)]), (2, [(1, 0), (2, 1)])) for r, b in some], "rank long, block long, replicate long")
    got = sorted((r["replicate"], r["cut"]) for r in S.boundaries(sample, "replicate").collect())
    assert got == [(1, (5 + 8) // 2 + 1), (1, (8 + 30) // 2 + 1), (2, 2)]


def test_fit_on_samples(spark):
    """Partitions from samples, scored on all rows: two planted clusters come out, each replicate gives parents."""
    rng = np.random.default_rng(11)
    rows = [(k, f"m{k}", 1, k, int(rng.binomial(150 + k % 7, (0.8 if k % 2 else 0.3) / 2)), 150 + k % 7, 1, 2) for k in range(400)]
    df = spark.createDataFrame(rows, "original_row long, mutation_id string, chrom long, pos long, alt_count long, depth long, major_cn long, total_cn long")
    sampling = {"size": 90, "replicates": 2, "seed": 4, "window": 0.1, "overlap": 0.05}
    _, found, candidates = P.fits(df, 0.9, most=3, sampling=sampling)
    best = P.best(found)
    assert best.k == 2 and best.centers == pytest.approx([0.8, 0.3], abs=0.03) and best.n == 400
    assert {r["parent_rep"] for r in candidates.where("kind = 'native'").collect()} == {1, 2}
    _, only, _ = P.fits(df, 0.9, only=2)
    assert len(only) == 1 and only[0].k == 2 and only[0].bic <= best.bic + 1e-3


@pytest.mark.parametrize("most", [5, 40, 2048])
def test_narrow_modes_against_all_of_them(spark, most):
    rng = np.random.default_rng(8)
    obs = sorted({(int(rng.integers(0, d + 1)), int(d), int(m), int(m + rng.integers(0, 2))) for d, m in zip(rng.choice([50, 10**5, 10**7], 160), rng.integers(1, 9, 160), strict=True)} | {(0, 10**7, 3, 3), (10**7, 10**7, 4, 4)})
    every = []
    for a, d, major, total in obs:
        den = 0.2 + 0.9 * total
        se = den * max(math.sqrt(a / d * (1 - a / d) / d), 0.5 / d)
        every += [a / d * den / m for m in range(1, major + 1) if a and m > max(a / d * den / 0.9, se / (0.9 / 1024))]
    picked = every if len(every) <= most else [every[k * (len(every) - 1) // (most - 1)] for k in range(most)]
    df = spark.createDataFrame([(*o, 1) for o in obs], "alt_count long, depth long, major_cn long, total_cn long, freq long").repartition(3)
    got = sorted(r["cp"] for r in modes.narrow_modes(df, 0.9, most).collect())
    assert len(every) > 60 and got == pytest.approx(sorted(set(picked)), rel=1e-12)
    assert modes.narrow_modes(df.where("depth = 50"), 0.9).collect() == []


def test_blocks_are_refitted_on_distinct_observations(spark, monkeypatch):
    """block_refit's passes read each distinct observation once, however many rows share it."""
    from tallyspan import fit_queries, queries

    sf, seen = "/root/testdata/sf0.001", []
    monkeypatch.setattr(fit_queries.B, "refit", lambda rows, purity, spans, surely: (seen.append((rows, spans)), ([0.5] * len(spans), [0.0] * len(spans), [1.0] * len(spans)))[1])
    fit_queries.block_refit(spark, sf)
    rows, spans = seen[0]
    every = queries._retained(spark, sf)
    assert rows.count() == every.select(*M.KEY).distinct().count() < every.count() == rows.agg(F.sum("freq")).first()[0]
    assert len(spans) == 6 and spans[-1][1] == rows.count()


def test_rows_are_not_shuffled_for_their_samples(spark):
    """Rows meet the ends of their windows' quotas where they are; the only rows that are dealt by window are those of its last bucket."""
    rows = spark.range(1000).select(F.col("id").alias("original_row"), (F.col("id") % 100 / 100).alias("v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        drawn = S.window_samples(rows, F.col("v"), 50, 3, 3, 0.1, 0.04)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and drawn.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_samples_read_the_ledger_once(spark, monkeypatch):
    """The samples' queries store the few columns they need instead of joining rows to segments for every pass."""
    from tallyspan import fit_queries

    made, keep = [], fit_queries.store
    monkeypatch.setattr(fit_queries, "store", lambda df, name="step": (made.append((name, df.columns)), keep(df, name))[1])
    plan = fit_queries.sample_faults(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert made == [("shares", ["original_row", "share"])] and "s_pos" not in plan
    out = fit_queries.sample_expansion(spark, "/root/testdata/sf0.001")
    assert "s_pos" not in out._jdf.queryExecution().optimizedPlan().toString() and [c for n, c in made if n == "rows"] == [["original_row", "chrom", "pos", "alt_count", "depth"]]
