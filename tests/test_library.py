"""The library's own operators: parsing, joins, likelihoods, chain, selection, fitting, runs."""

import dataclasses
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan import api
from tallyspan.functions import likelihood as L
from tallyspan.functions import literals
from tallyspan.operators import chain as C
from tallyspan.operators import checks, intervals, ledger, records, replay, selection
from tallyspan.operators import mixture as M
from tallyspan.plans import fit as P
from tallyspan.plans import scratch
from tallyspan.plans.ranks import ranked
from tallyspan.sources import text_tables as T
from tallyspan.streaming import ingest


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").orderBy("k").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    got = column(spark, ["1", "-2.5e3", ".5", "5.", "0x10", "0x1.8p1", "1d", "1_0", " 1", "", "nan", "inf", "١", "abc", None], "string", literals.number)
    want = [1, -2500, 0.5, 5, 16, 3, *[math.nan] * 5, math.inf, *[math.nan] * 3]
    assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, want, strict=True))


def test_chromosomes_and_coordinates(spark):
    assert column(spark, ["1", "chr22", "CHR7", "X", "0", "23", "chr", "01"], "string", literals.chromosome) == [1, 22, 7, None, None, None, None, 1]
    assert column(spark, ["1", "2147483647", "2147483648", "0", "1.5", "0x10", "1e3"], "string", literals.coordinate) == [1, 2147483647, None, None, None, 16, 1000]
    assert column(spark, [100000, 1200000, 123456, 1, 2147483647, 10, 10000000, 120000000], "long", literals.spelling) == ["1e+05", "1200000", "123456", "1", "2147483647", "10", "1e+07", "1.2e+08"]


def test_lgamma(spark):
    xs = [1, 2, 3, 7, 50, 1000, 2**31]
    assert column(spark, xs, "long", L.lgamma) == pytest.approx([math.lgamma(x) for x in xs], abs=1e-9, rel=1e-12)


def plain_kernel(r, n, major, total, purity, cp):
    den, out = 2 * (1 - purity) + purity * total, []
    for m in range(1, major + 1):
        p = min(1, cp * m / den)
        xlogy = lambda x, y: 0 if x == 0 else x * math.log(y) if y > 0 else -math.inf
        out.append(math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1) - math.log(major) + xlogy(r, p) + xlogy(n - r, 1 - p))
    return out


OBS = [(0, 10, 2, 3), (10, 10, 1, 1), (3, 30, 4, 6), (29, 30, 1, 2), (30, 30, 3, 3)]


@pytest.mark.parametrize("cp", [0.0, 0.3, 0.9])
def test_likelihood(spark, cp):
    df = spark.createDataFrame([(k, *o) for k, o in enumerate(OBS)], "k int, alt_count long, depth long, major_cn long, total_cn long")
    rows = M.prepared(df, 0.9).withColumn("ker", M.kernel(F.lit(cp)))
    got = rows.orderBy("k").select("ker", M.loglik(F.lit(cp)).alias("ll"), L.posterior(F.col("ker")).alias("post")).collect()
    for o, r in zip(OBS, got, strict=True):
        ker = plain_kernel(*o, 0.9, cp)
        top = max(ker)
        ll = top + math.log(sum(math.exp(v - top) for v in ker)) if top > -math.inf else -math.inf
        assert r["ll"] == pytest.approx(ll, rel=1e-10, abs=1e-10)
        assert r["ker"] == pytest.approx(ker, rel=1e-10, abs=1e-10)
        assert r["post"] is None if top == -math.inf else r["post"] == pytest.approx([math.exp(v - ll) for v in ker], abs=1e-9)


def tables(spark, n=400, seed=0):
    rng = random.Random(seed)
    cna, at = [], {c: 1 for c in (1, 2, 3)}
    for k in range(60):
        c = rng.choice([1, 2, 3])
        start = at[c] + rng.randint(0, 200)
        end = start + rng.randint(0, 500)
        at[c] = end + 1
        major = rng.randint(1, 3)
        cna.append((k, c, start, end, major, 1, major + 1))
    points = [(k, f"m{k}", rng.choice([1, 2, 3, 4]), 5 * k + 1, rng.choice([-1, 0, 20]), rng.choice([0, 30])) for k in range(n)]
    p = spark.createDataFrame(points, "original_row long, mutation_id string, chrom long, pos long, alt_count long, ref_count long")
    return p, spark.createDataFrame(cna, "segment_id long, chrom long, s_pos long, e_pos long, major_cn long, minor_cn long, total_cn long"), points, cna


@pytest.mark.parametrize("bucket", [16, 1 << 16])
def test_interval_joins(spark, bucket):
    p, s, points, cna = tables(spark)
    want = sorted((k, next((g[0] for g in cna if g[1] == c and g[2] <= pos <= g[3]), None)) for k, _, c, pos, _, _ in points)
    for joined in (intervals.joined(p, s, bucket), intervals.joined_in_order(p, s)):
        assert sorted((r["original_row"], r["segment_id"]) for r in joined.collect()) == want
    assert intervals.overlaps(s).count() == 0 and intervals.overlaps(s.withColumn("e_pos", F.col("e_pos") + 10_000)).count() > 0
    assert tuple(checks.differences(intervals.joined(p, s, bucket), intervals.joined_in_order(p, s)).first()) == (0, 0)


def test_ledger(spark):
    p, s, points, cna = tables(spark)
    for r in ledger.ledger(p, s).collect():
        bad = r["alt_count"] < 0 or r["alt_count"] + r["ref_count"] == 0
        assert r["reason"] == (ledger.INVALID if bad else ledger.UNCOVERED if r["segment_id"] is None else ledger.RETAINED)
        assert (r["status"] == "retained") == (r["reason"] == "retained")
    assert ledger.summary(ledger.ledger(p, s)).first()["n_rows"] == len(points)


def test_ranked(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id"))
    got = ranked(df, [F.col("x")], "r", 0).orderBy("x").select("r").collect()
    assert [r[0] for r in got] == list(range(1000))


def test_chain(spark):
    rng = random.Random(3)
    values = [rng.choice([0.1, 0.1, 0.2, 0.5, 0.50001, 0.9]) for _ in range(300)]
    rows = spark.createDataFrame([(k, v, k % 22 + 1, k * 1000 + 1) for k, v in enumerate(values)], "original_row long, v double, chrom long, pos long")
    ranks = C.chain(rows, F.col("v")).cache()
    order = sorted(values)
    assert [r["v"] for r in ranks.orderBy("rank").collect()] == order
    steps = sorted(((k, order[k + 1] - order[k]) for k in range(299) if order[k + 1] != order[k]), key=lambda x: (-abs(x[1]), x[0]))[:3]
    assert [(r["rank"], r["step"]) for r in C.jumps(ranks, "v", 4).orderBy("place").collect()] == steps
    blocks = C.labelled(ranks, sorted(k + 1 for k, _ in steps))
    assert sum(r["n"] for r in C.block_stats(blocks, "v").collect()) == 300


def test_best_blocks(spark):
    rng = np.random.default_rng(0)
    for n, q in ((40, 1), (40, 3), (7, 4)):
        v = rng.standard_normal((n, q))
        df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(v)], "rank long, " + ", ".join(f"s{j} double" for j in range(q)))
        total, cuts = C.best_blocks(df, [F.col(f"s{j}") for j in range(q)])
        def score(c, v=v, n=n):
            return sum(v[a:b, j].sum() for j, (a, b) in enumerate(zip([0, *c], [*c, n], strict=True)))
        want = max(score(c) for c in combinations(sorted([*range(n + 1)] * 3), q - 1)) if n < 10 else None
        assert score(cuts) == pytest.approx(total)
        if want is not None:
            assert total == pytest.approx(want)


def test_selection(spark):
    parents = spark.createDataFrame([(3, 0, [2, 5]), (4, 1, [2, 5, 9])], "requested_k long, replicate long, cuts array<int>")
    got = {(r["budget"], tuple(r["cuts"])): (r["parent_k"], r["kind"]) for r in selection.coarsenings(parents, [2, 3]).collect()}
    assert got == {(2, (2,)): (3, "adjacent_coarsening"), (2, (5,)): (3, "adjacent_coarsening"), (2, (9,)): (4, "adjacent_coarsening"), (3, (2, 5)): (3, "native"), (3, (2, 9)): (4, "adjacent_coarsening"), (3, (5, 9)): (4, "adjacent_coarsening")}
    merged = parents.withColumn("requested_k", F.col("requested_k") + 1)  # fewer blocks than asked for: routed to both
    got = {(r["budget"], tuple(r["cuts"])): (r["parent_k"], r["kind"]) for r in selection.coarsenings(merged, [3, 4]).collect()}
    assert got[(4, (2, 5))] == (4, "native") and got[(3, (2, 5))] == (4, "capacity_reuse") and got[(4, (2, 5, 9))] == (5, "capacity_reuse") and got[(3, (2, 9))] == (5, "adjacent_coarsening")
    with pytest.raises(Exception, match="more than 16"):
        selection.coarsenings(spark.createDataFrame([(3, 0, list(range(1, 20)))], "requested_k long, replicate long, cuts array<int>"), [2]).collect()
    rows = spark.range(1, 101).select(F.col("id").alias("original_row"), (F.col("id") / 100).alias("v"))
    assert sum(r["take"] for r in selection.quotas(rows, F.col("v"), 7, 31).collect()) == 31
    assert selection.sampled(rows, F.col("v"), 7, 31, 1).count() == 31


def simulated(tmp_path, n=240):
    rng = np.random.default_rng(1)
    lines, cna = ["chromosome_index position alt_count ref_count"], ["chromosome_index start_position end_position major_cn minor_cn total_cn"]
    for c in range(1, 5):
        cna.append(f"chr{c} 1 100000 1 1 2")
    for k in range(n):
        cp = 0.8 if k % 2 else 0.3
        alt = rng.binomial(200, cp / 2)
        lines.append(f"{k % 4 + 1}\t{100 + k * 7} {alt} {200 - alt}")
    lines += ["", "1 99999999 5 5", "2 50000 x 5"]
    for name, text in (("p", lines), ("s", cna), ("u", ["0.8"])):
        (tmp_path / name).write_text("\n".join(text) + "\n")
    return [str(tmp_path / x) for x in "psu"]


def test_fit_recovers_two_clusters(spark, tmp_path):
    paths = simulated(tmp_path)
    about = api.validate_inputs(spark, *paths)
    assert about["n_retained"] == 240 and about["reasons"] == {"retained": 240, "no_cna_segment": 1, "invalid_counts_or_zero_depth": 1}
    out = f"file://{tmp_path}/out"
    assert api.fit(spark, *paths, out, most=3)["clusters"] == 2
    found = api.load_result(spark, out)
    got = found["clusters"].orderBy("cluster_index").collect()
    assert [r["cellular_prevalence"] for r in got] == pytest.approx([0.8, 0.3], abs=0.02) and sum(r["num_SNV"] for r in got) == 240
    with pytest.raises(FileExistsError):
        T.publish(found, out, {})
    assert {f["k"]: f["selected"] for f in found["fits"].collect()} == {1: False, 2: True, 3: False}
    assert found["posterior_mutations"].count() == 240 and found["posterior_summary"].first()["count_gap"] < 1e-6
    faults = api.verify(spark, out)
    assert len(faults) == 18 and not any(faults.values())
    wrong = dict(found, clusters=found["clusters"].withColumn("cluster_index", 1 - F.col("cluster_index")), posterior_flow=found["posterior_flow"].limit(3))
    faults = {r["rule"] for r in P.faults(ledger.retained(found["ledger"]), wrong, 0.8).collect() if r["n"]}
    assert {"order", "posterior_flow"} <= faults and "fit" not in faults


@pytest.mark.parametrize(("name", "change", "said"), [("p", "a b\n1 2 3", "width"), ("p", "", "empty"), ("p", "chromosome_index position alt_count", "lacks"), ("p", "a a\n1 1", "repeats"), ("u", "0.5 0.6", "one number"), ("u", "1.2", "not above"), ("s", "chromosome_index start_position end_position major_cn minor_cn total_cn\n1 5 9 1 1 3\n1 8 12 1 0 1", "copy_number 1, overlap 1")])
def test_refusals(spark, tmp_path, name, change, said):
    paths = simulated(tmp_path, 8)
    (tmp_path / name).write_text(change + "\n")
    if name == "p":
        with pytest.raises(ValueError, match=said):
            T.read_table(spark, paths[0], api.POINT_COLUMNS if said == "lacks" else ["a"])
    else:
        with pytest.raises(ValueError, match=said):
            api.validate_inputs(spark, *paths)


@pytest.mark.parametrize("wrong", [{"max_clusters": 0}, {"max_clusters": 11}, {"clusters": True}, {"sample_id": " "}, {"sample_id": "a/b"}, {"assembly": "a\tb"}, {"device": "cuda"}, {"subsample_size": 0}, {"replicates": 2}, {"seed": -1}, {"window_size": 1.5}, {"overlap": 0.05}, {"window_size": math.nan}])
def test_config_refusals(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        api.FitConfig(**wrong)


def test_config_capacities():
    assert api.FitConfig(4).capacities(3) == [1, 2, 3] and api.FitConfig(clusters=5).capacities(9) == [5]
    for config, n in ((api.FitConfig(clusters=5), 4), (api.FitConfig(subsample_size=9), 50), (api.FitConfig(), 0)):
        with pytest.raises(ValueError, match="clusters"):
            config.capacities(n)
    one = api.FitConfig(3, subsample_size=40, replicates=2, seed=7, window_size=0.2, overlap=0.1)
    assert api.FitConfig.from_dict(dataclasses.asdict(one)) == one and one.sampling() == {"size": 40, "replicates": 2, "seed": 7, "window": 0.2, "overlap": 0.1} and api.FitConfig().sampling() is None
    with pytest.raises(ValueError, match="exactly"):
        api.FitConfig.from_dict({"seed": 1})


def test_mixture_weights(spark):
    df = M.prepared(spark.createDataFrame([(a, 100, 1, 2, f) for a, f in ((40, 3), (41, 2), (15, 5))], "alt_count long, depth long, major_cn long, total_cn long, freq long"), 0.9)
    (w, _, gap), (one, _, _) = P.mixture_weights(df, [[0.8, 0.3], [0.5]], [[1, 1], [1]])
    assert w == pytest.approx([0.5, 0.5], abs=1e-3) and gap <= P.WEIGHT_GAP and one == [1]


def test_partitions_against_all_cuts(spark):
    rng = random.Random(5)
    seen = {(a, 40, *rng.choice([(1, 2), (2, 3), (3, 4)])) for a in rng.sample(range(40), 14)}
    obs = spark.createDataFrame([(*o, rng.randint(1, 4)) for o in sorted(seen)], "alt_count long, depth long, major_cn long, total_cn long, freq long")
    ready = M.prepared(obs, 0.9).withColumn("pilot", F.col("alt_count") / F.col("depth"))
    chain = scratch.store(ranked(ready, [F.col("pilot"), F.col("major_cn")], "rank", 0), "chain")
    found = P.partitions(chain, 0.9, *P.first_blocks(chain, 0.9, 14, 4))
    rows = chain.orderBy("rank").toPandas()
    like = P.logliks(*(rows[c].to_numpy() for c in P.NEEDED), np.linspace(0, 0.9, 4001)) * rows["freq"].to_numpy()[:, None]
    block = {(i, j): like[i:j].sum(axis=0).max() for i, j in combinations(range(15), 2)}
    assert [f.k for f in found] == [1, 2, 3, 4]
    for f in found:
        best = max(sum(block[pair] for pair in zip((0, *cuts), (*cuts, 14), strict=True)) for cuts in combinations(range(1, 14), f.k - 1))
        assert f.settled and f.conditional == pytest.approx(best, rel=1e-4) and f.n == rows["freq"].sum()
        assert f.gap <= P.WEIGHT_GAP and sum(f.weights) == pytest.approx(1)


def test_pilot_is_at_the_optimum(spark):
    rng = random.Random(8)
    seen = {(rng.randint(0, 30), 30, 2, 3): rng.randint(1, 9) for _ in range(60)}
    obs = spark.createDataFrame([(*o, f) for o, f in seen.items()], "alt_count long, depth long, major_cn long, total_cn long, freq long").repartition(3)
    got = P.pilot(obs, 0.8, points=33).orderBy("alt_count").toPandas()
    like = np.exp(P.logliks(*(got[c].to_numpy() for c in P.NEEDED), np.linspace(0, 0.8, 33)))
    freq, w = got["freq"].to_numpy() / got["freq"].sum(), np.full(33, 1 / 33)
    for _ in range(20000):
        w = w * ((freq / (like @ w)) @ like)
    assert got["pilot"].to_numpy() == pytest.approx(like @ (w * np.linspace(0, 0.8, 33)) / (like @ w), abs=2e-3)


def test_records_and_replays(spark):
    rows = spark.createDataFrame([(k, k % 2, 1, float(k % 5), "native" if k % 3 else "derived") for k in range(12)], "candidate_id long, budget long, q long, bic double, kind string")
    assert records.where_all(rows, ("kind", "budget"), kind="native", budget=[0]).count() == 4
    with pytest.raises(ValueError, match="filtered by: bic"):
        records.where_all(rows, ("kind",), bic=1.0)
    assert {r["state"]: r["n"] for r in records.link_states(rows, F.when(F.col("candidate_id") > 0, F.col("candidate_id") - 1)).collect()} == {"root": 1, "falling": 2, "rising": 9}
    ranks = spark.range(10).withColumnRenamed("id", "rank")
    assert replay.order_check(ranks).first()["valid"] and not replay.order_check(ranks.where("rank <> 4")).first()["valid"]
    assert sorted(r["rank"] for r in replay.even_ranks(ranks, 4).collect()) == [0, 3, 6, 9]
    assert sorted(tuple(r) for r in replay.runs(ranks, F.col("rank").isin(0, 1, 5, 7, 8, 9)).select("first_rank", "n").collect()) == [(0, 2), (5, 1), (7, 3)]
    obs = spark.createDataFrame([(k, *o) for k, o in enumerate(OBS)], "original_row long, alt_count long, depth long, major_cn long, total_cn long")
    grad = {r["original_row"]: (r["gradient"], r["curvature"]) for r in replay.gradients(obs, 0.9, 0.3).collect()}
    for k, o in enumerate(OBS):
        f = lambda cp, o=o: math.log(sum(math.exp(v) for v in plain_kernel(*o, 0.9, cp)))
        assert grad[k][0] == pytest.approx((f(0.3 + 1e-5) - f(0.3 - 1e-5)) / 2e-5, rel=1e-5, abs=1e-4)
        v = np.array(plain_kernel(*o, 0.9, 0.3))
        own = [-(up - 2 * mid + low) / 1e-8 for up, mid, low in zip(plain_kernel(*o, 0.9, 0.3 + 1e-4), v, plain_kernel(*o, 0.9, 0.3 - 1e-4), strict=True)]
        assert grad[k][1] == pytest.approx(max(1e-8 / 0.81, np.exp(v - f(0.3)) @ own), rel=1e-3, abs=1e-3)  # each multiplicity's own curvature, by its share
    edge = spark.createDataFrame([(0, 9, 10, 1, 1), (1, 9, 10, 2, 2), (2, 8, 10, 2, 2), (3, 10, 10, 2, 2), (4, 7, 10, 2, 2), (5, 0, 4, 2, 2)], "original_row long, alt_count long, depth long, major_cn long, total_cn long")
    got = {r["original_row"]: r for r in replay.gradients(edge, 1.0, 1.0).collect()}
    assert (got[0]["loglik"], got[0]["gradient"], got[0]["curvature"]) == (-math.inf, 0.0, 1.0)  # impossible
    for k, (a, n) in enumerate([(9, 10), (8, 10), (10, 10), (7, 10)], 1):  # one copy of two: half the reads; two of two: all of them
        half, r = 0.5**n, n - a
        mass = half + (r == 0)
        slope = (half * (a - r) + (r == 0) * a - (r == 1)) / mass
        assert got[k]["gradient"] == pytest.approx(slope)
        assert got[k]["curvature"] == (math.inf if r == 1 else pytest.approx((half * (a + r) + (r == 0) * a + 2 * (r == 2)) / mass))
    assert got[5]["gradient"] == pytest.approx(-4.0) and replay.gradients(edge, 1.0, 0.0).where("original_row = 5").first()["gradient"] == pytest.approx(-(0.5 * 4 + 4) / 2)


def test_paths_by_pointer_doubling(spark):
    rng = random.Random(6)
    before = {k: rng.choice([None, *range(k)]) if k % 9 else None for k in range(120)} | {200 + k: 200 + (k + 1) % 5 for k in range(5)} | {300: 203, 301: 300, 400: -7, 401: 400} | {500 + k: 499 + k if k else None for k in range(70)}
    value = {k: rng.randint(0, 9) for k in before}
    df = spark.createDataFrame([(k, p, float(value[k])) for k, p in before.items()], "candidate_id long, p long, v double").repartition(3)
    got = {r["candidate_id"]: tuple(r)[1:] for r in records.paths(df, F.col("p"), F.col("v")).collect()}
    assert len(got) == len(before)
    for k in before:
        way, seen = [k], {k}
        while before[way[-1]] in before and before[way[-1]] not in seen:
            way.append(before[way[-1]])
            seen.add(way[-1])
        if before[way[-1]] in before:
            assert got[k] == ("cycle", None, None, None, None)
            continue
        falls = [n for n, (a, b) in enumerate(zip(way, way[1:], strict=False), 1) if value[a] < value[b]]
        assert got[k] == ("path" if before[way[-1]] is None else "missing", way[-1], len(way) - 1, len(falls), falls[0] if falls else None)
    assert records.paths(df.limit(0), F.col("p"), F.col("v")).collect() == []


def test_scalar_is_read_whole(spark, tmp_path):
    (tmp_path / "u").write_text("\n" * 3000 + "0.5\n")
    assert T.read_scalar(spark, str(tmp_path / "u")) == 0.5
    (tmp_path / "v").write_text("0.5\n" + "\n" * 3000 + "0.6")
    with pytest.raises(ValueError, match="one number"):
        T.read_scalar(spark, str(tmp_path / "v"))


def test_no_shared_folder_on_a_cluster():
    class Nowhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Nowhere.conf)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Nowhere)


def test_stream(spark, tmp_path):
    p, s, points, _ = tables(spark, 60)
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    ingest.to_parquet(ingest.classified(stream, s), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


def test_ranked_shuffles_rows_once(spark):
    """Rows are numbered where they are dealt; only counts are summed afterwards, and columns that nobody asks for are not written."""
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), (F.col("id") * 3).alias("wide"), "id")
    got = ranked(df, ["x"], "r", 5, keep=["x", "id"])
    assert got.columns == ["x", "id", "r"] and all(r["r"] == r["x"] + 5 for r in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert ranked(df.limit(0), [F.col("x")], "r").collect() == []


def test_places_are_ranks_of_the_chain(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice([0.0, 0.1, 0.1, 0.5]), k % 22 + 1, k * 1000 + 1) for k in range(400)], "v double, chrom long, pos long").repartition(3)
    ranks = C.chain(rows, F.col("v")).cache()
    sizes = rows.groupBy(F.col("v").alias("pilot")).agg(F.count("*").alias("n"))
    some = ranks.where("rank % 37 = 0 or rank = 399").select("pilot", "chrom", "pos", F.col("rank").alias("own"))
    got = C.places(rows, F.col("v"), sizes, some).collect()
    assert len(got) == 12 and all(r["rank"] == r["own"] for r in got)
