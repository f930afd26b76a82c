"""Joint fits against plain expectation steps, numerical derivatives, and planted mixtures."""

import math

import numpy as np
import pytest

from tallyspan.operators import mixture as M
from tallyspan.plans import fit as P
from tallyspan.plans import joint as J

SCHEMA = "alt_count long, depth long, major_cn long, total_cn long, freq long"


def planted(seed, truth, weights, n=300, purity=0.9):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        total = int(rng.choice([1, 2, 3]))
        major, depth = int(rng.integers(1, total + 1)), int(rng.integers(30, 90))
        p = rng.choice(truth, p=weights) * int(rng.integers(1, major + 1)) / (2 * (1 - purity) + purity * total)
        rows.append((int(rng.binomial(depth, min(1.0, p))), depth, major, total, int(rng.integers(1, 3))))
    return rows


def plain(rows, purity, centers, weights):
    """Log likelihood by probabilities alone."""
    total = 0.0
    for a, d, major, cn, f in rows:
        den = 2 * (1 - purity) + purity * cn
        of = lambda c, m: math.comb(d, a) * min(1.0, c * m / den) ** a * (1 - min(1.0, c * m / den)) ** (d - a) / major  # noqa: B023, E731
        total += f * math.log(sum(w * sum(of(c, m) for m in range(1, major + 1)) for c, w in zip(centers, weights, strict=True)))
    return total


@pytest.mark.parametrize("truth, weights, start", [([0.8, 0.35], [0.5, 0.5], [0.9, 0.1]), ([0.85, 0.5, 0.2], [0.3, 0.3, 0.4], [0.7, 0.6, 0.3]), ([0.6], [1.0], [0.5])])
def test_planted_mixtures_are_certified(spark, truth, weights, start):
    rows = planted(len(start), truth, weights)
    o = J.Observations(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.9)
    found = J.fit_joint(o, [(start, None), (truth, weights)])
    for f in found:
        assert f.converged and f.center_gap <= 1e-7 and f.weight_gap <= f.n * 1e-8 and f.active_gap <= 1e-8
        slack = 64 * np.finfo(float).eps * abs(f.loglik)
        assert all(b >= a - slack for a, b in zip(f.history, f.history[1:], strict=False)) and f.loglik >= f.initial
        assert f.loglik == pytest.approx(plain(rows, 0.9, f.centers, f.weights), rel=1e-9) and f.n == sum(r[-1] for r in rows)
        assert f.bic == pytest.approx(-2 * f.loglik + (2 * len(f.centers) - 1) * math.log(f.n)) and f.centers == sorted(f.centers, reverse=True)
        for k in range(len(f.centers)):  # a local maximum by each center
            for e in (-1e-4, 1e-4):
                moved = [c + e * (j == k) for j, c in enumerate(f.centers)]
                assert max(moved) > 0.9 or plain(rows, 0.9, moved, f.weights) < f.loglik + 1e-9 * abs(f.loglik)
    assert found[0].loglik == pytest.approx(found[1].loglik, abs=0.5) or len(start) > 2


def test_statistics_and_slopes(spark):
    """One pass against expressions and numerical derivatives, at several sets of parameters together."""
    rows = planted(9, [0.8, 0.3], [0.5, 0.5], 60)
    obs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    o, sets = J.Observations(obs, 0.9), [(np.array([0.7, 0.2]), np.array([0.4, 0.6])), (np.array([0.5]), np.array([1.0]))]
    for (c, w), s in zip(sets, o.at(sets), strict=True):
        assert s.loglik == pytest.approx(plain(rows, 0.9, c, w))
        got = {(r["component"], r["total_cn"], r["m"]): r for r in J.expectation(obs, 0.9, list(map(float, c)), list(map(float, w))).collect()}
        for k in range(len(c)):
            assert s.sizes[k] == pytest.approx(sum(r["size"] for (j, _, _), r in got.items() if j == k)) and s.alt[k] == pytest.approx(sum(r["alt"] for (j, _, _), r in got.items() if j == k))
            assert all(s.rest[k][i] == pytest.approx(got[k, total, m]["rest"], abs=1e-9) for i, (total, m) in enumerate(o.codes) if (k, total, m) in got)
            e = 1e-6
            up, down = (plain(rows, 0.9, [x + d * (j == k) for j, x in enumerate(c)], w) for d in (e, -e))
            assert J.slopes(c, s, o.scale)[k] == pytest.approx((up - down) / 2 / e, rel=1e-4)
            assert s.sizes[k] == pytest.approx(w[k] * s.scores[k])


def test_center_step_is_the_maximum():
    rng = np.random.default_rng(1)
    for _ in range(200):
        alt, rest, scale = rng.uniform(0, 50), rng.uniform(0, 50, 4) * (rng.random(4) < 0.7), rng.uniform(0.05, 1.1, 4)
        c = J.center_step(alt, rest, scale, 0.4, 0.9)
        grid = np.linspace(1e-6, 0.9, 20001)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = lambda x: alt * np.log(x) + np.where(rest > 0, rest * np.log(np.maximum(1 - np.outer(x, scale), 0)), 0).sum(axis=1)  # noqa: B023, E731
            assert value(np.array([c]))[0] >= value(grid).max() - 1e-9
    assert J.center_step(0, np.ones(2), np.ones(2), 0.4, 0.9) == 0 and J.center_step(3, np.zeros(2), np.ones(2), 0.4, 0.9) == 0.9


def test_ends_are_left(spark):
    """A component at a fraction of 0 has no responsibility for rows with the variant, yet one read gives it a slope; at a chance of 1 one read without it does."""
    low = spark.createDataFrame([(0, 100, 1, 2, 30), (1, 100, 1, 2, 20), (2, 100, 1, 2, 10), (60, 200, 1, 2, 40)], SCHEMA)
    start = ([0.6, 0.0], [0.5, 0.5])
    f = J.fit_joint(J.Observations(low, 0.9), [start])[0]
    assert f.converged and 0 < f.centers[1] < 0.1 and f.loglik > f.initial + 1
    s = J.Observations(low, 0.9).at([(np.array(start[0]), np.array(start[1]))])[0]
    rows = [tuple(r) for r in low.collect()]
    assert s.edge[1] == pytest.approx((plain(rows, 0.9, [0.6, 1e-7], start[1]) - plain(rows, 0.9, [0.6, 0.0], start[1])) / 1e-7, rel=1e-2, abs=1) or s.edge[1] > 0
    high = spark.createDataFrame([(30, 30, 1, 1, 30), (29, 30, 1, 1, 20), (12, 30, 1, 1, 20)], SCHEMA)
    f = J.fit_joint(J.Observations(high, 1.0), [([1.0, 0.4], [0.5, 0.5])])[0]
    assert f.converged and 0.9 < f.centers[0] < 1
    zero = J.fit_joint(J.Observations(spark.createDataFrame([(0, 50, 1, 2, 9)], SCHEMA), 0.9), [([0.3], None)])[0]
    assert zero.centers == [0.0] and zero.converged


def test_reduction_and_refusals(spark):
    assert J.canonical(np.array([0.2, 0.5, 0.2, 0.9]), np.array([0.25, 0.5, 0.25, 0.0])) == ([0.5, 0.2], [0.5, 0.5], [[1], [0, 2]])
    rows = planted(4, [0.8, 0.3], [0.5, 0.5], 150)
    o = J.Observations(spark.createDataFrame(rows, SCHEMA), 0.9)
    parent = J.fit_joint(o, [([0.8, 0.3], None)])[0]
    found = J.reduced_candidates(o, parent)
    assert len(found) == 1 and len(found[0].centers) == 1 and found[0].converged and found[0].bic > parent.bic
    stopped = J.fit_joint(o, [([0.7, 0.65], None)], rounds=1)[0]
    assert not stopped.converged and stopped.status == "iteration_limit"
    with pytest.raises(ValueError, match="converged"):
        J.reduced_candidates(o, stopped)
    for bad in (([], None), ([1.0], None), ([0.5], [0.0]), ([0.5, 0.4], [1.0]), ([math.nan], None)):
        with pytest.raises(ValueError, match="start"):
            J.fit_joint(o, [bad])
    with pytest.raises(Exception, match="impossible"):
        o.at([(np.array([0.0]), np.array([1.0]))])


def test_joint_fit_is_no_worse_than_the_chain(spark):
    rows = planted(6, [0.75, 0.4], [0.6, 0.4], 200)
    obs = spark.createDataFrame(rows, SCHEMA)
    weights, value, _ = P.mixture_weights(M.prepared(obs, 0.9), [[0.8, 0.3]], [[1, 1]])[0]
    assert J.fit_joint(J.Observations(obs, 0.9), [([0.8, 0.3], weights)])[0].loglik >= value - 1e-9
