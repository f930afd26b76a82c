"""Whitening and hard negatives against plain computations, with odd inputs."""

import math

import numpy as np
import pytest

from tallyspan.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


@pytest.fixture
def vectors(spark):
    """vectors(rows): embeddings of (vec_id, vector, label), and columns that clash with results."""
    return lambda rows: spark.createDataFrame([(i, v, y, "x", "y") for i, v, y in rows], SCHEMA)


def random_vectors(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d))
    y = rng.integers(0, labels, n)
    x = (centres[y] + rng.standard_normal((n, d))) * np.linspace(0.05, 0.4, d)
    return [(int(k), [float(np.float32(c)) for c in row], int(label)) for k, row, label in zip(range(n), x, y, strict=True)]


def brute_whitening(rows, k):
    good = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    axes, values = axes[:, ::-1][:, :k], values[::-1]
    return [i for i, _ in good], ((n * x - s) ** 2).sum(axis=1), centred @ axes / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("d, n, partitions", [(5, 80, 3), (40, 300, 1), (48, 400, 7)])
def test_whitening_equals_eigenvectors(vectors, monkeypatch, d, n, partitions):
    monkeypatch.setattr(whitening, "FAN", 2)  # partial sums are added up in levels
    rows = random_vectors(d, n, d)
    rows += [(1000, None, 1), (1001, [None] * d, 1), (1002, [math.nan] * d, 1), (1003, [math.inf] * d, None), (None, rows[0][1], None), rows[1], (1004, [], 0), (1005, [0.5], 0)]
    got = whitening.report(vectors(rows).repartition(partitions)).collect()
    ids, deviation, white, explained = brute_whitening([r for r in rows if r[0] not in (1004, 1005)], 8)
    k = min(8, d)
    assert len(got) == k * len(ids) and {r["n"] for r in got} == {len(ids)} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is not None, i or 0, int(v)) for i, v in zip(ids, deviation, strict=True))
    at = {i: w for i, w in zip(ids, white, strict=True)}
    for c in range(1, k + 1):
        mine = {r["vec_id"]: r for r in got if r["component"] == c}
        sign = np.sign(sum(mine[i]["whitened"] * at[i][c - 1] for i in mine))
        assert max(abs(mine[i]["whitened"] * sign - at[i][c - 1]) for i in mine) < 1e-9
        assert abs(mine[ids[0]]["explained"] - explained[c - 1]) < 1e-12 and mine[ids[0]]["identity_error"] < 1e-10


def test_whitening_of_little(vectors):
    assert whitening.report(vectors([])).collect() == []
    assert whitening.report(vectors([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1), (3, None, 1)])).collect() == []  # no variance
    line = whitening.report(vectors([(k, [float(k), 2.0 * k, 1.0], 0) for k in range(5)])).collect()  # one direction only
    assert {r["component"] for r in line} == {1} and len(line) == 5 and line[0]["identity_error"] < 1e-10
    assert whitening.report(vectors([(1, [1e30, 2.0], 0), (2, [1.0, 2.0], 1)]).limit(0)).collect() == []
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.report(vectors([(1, [1e30, 2.0], 0), (2, [1.0, 2.0], 1)]))


def test_filter_widens_its_block_on_a_flat_spectrum(spark, vectors):
    """A spectrum with no gap behind the wanted directions: the block grows until the directions are certified."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((400, 48)))[0] * np.sqrt(np.linspace(1.0, 0.999, 48)) * 4
    rows = whitening.whole(vectors([(k, [float(np.float32(c)) for c in v], 0) for k, v in enumerate(q)]))
    model = whitening.fit(rows, width=1)
    assert model.residuals.max() < 1e-12 and len(model.variances) == 8
    exact = whitening.fit(rows, width=48)
    assert np.abs(model.variances / exact.variances - 1).max() < 1e-10


def test_whitening_does_not_depend_on_partitions(vectors):
    rows = random_vectors(2, 500, 20)
    a, b = (whitening.fit(whitening.whole(vectors(rows).repartition(p))) for p in (3, 7))
    assert a.sums == b.sums and a.trace == b.trace and np.abs(a.directions - b.directions).max() < 1e-10


def brute_negatives(rows, every=50, positives=5, negatives_=3):
    good = [(i, [math.floor(256 * c) for c in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, v, y in good:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, z) for j, w, z in good if j != i), key=lambda t: t[:3])
        for s, none, j, _ in [t for t in scored if t[3] == y][:positives]:
            window = [t for t in scored if t[3] != y and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives_]
            out += [(i, None if none else j, k + 1, None if t[1] else t[2], -s, -t[0]) for k, t in enumerate(window)]
    return sorted(out, key=str)


@pytest.mark.parametrize("d, n, partitions, anchors", [(3, 400, 3, 4096), (24, 600, 7, 5), (64, 300, 1, 4096)])
def test_negatives_equal_brute_force(vectors, d, n, partitions, anchors):
    rows = random_vectors(n, n, d)
    rows += [(n + k, rows[1][1], k % 3) for k in range(60)]  # ties: one vector under many ids
    rows += [(2000, [0.0] * d, 1), (2001, None, 1), (2050, [math.nan] * d, 1), (2100, [None] * d, 1), (2150, rows[3][1], None), (None, rows[0][1], 1), (None, rows[5][1], 2), (-50, rows[7][1], 3), (2200, [], 1), (2201, [1.0], 1), (2202, [math.inf] * d, 2)]
    rows += [rows[100], rows[100], (100, rows[9][1], 2), rows[11]]  # repeated rows, and an id with two vectors
    got = negatives.mined(vectors(rows).repartition(partitions), anchors=anchors).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives([r for r in rows if r[1] is None or len(r[1]) == d])


def test_negatives_of_blocks_of_few_rows(vectors):
    """Blocks of few rows, and with fewer candidates than are kept: what is no candidate comes after what is one, and none counts twice."""
    none = negatives.NOTHING
    for found in ([none, none, -5, 7], [none] * 3, [7, none, none], [7] + [none] * 9, [none, 7] + [none] * 9 + [-5]):
        best = negatives.Best(1, 2)
        best.offer(np.array([0]), np.array(found)[:, None], np.arange(len(found)))
        want = sorted(((s, i) for i, s in enumerate(found) if s != none), reverse=True) + [(none, negatives.NO_ID)] * 2
        assert list(zip(best.score[0].tolist(), best.id[0].tolist(), strict=True)) == want[:2], found
    rows = random_vectors(77, 160, 4)
    want = brute_negatives(rows)
    for partitions in (20, 53):
        assert sorted(map(tuple, negatives.mined(vectors(rows).repartition(partitions)).collect()), key=str) == want


def test_negatives_where_bounds_decide(vectors, monkeypatch):
    """Well-separated clusters of very different norms: most pairs are never scored, and the rows stay right."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    rng = np.random.default_rng(4)
    axes = np.eye(6)
    rows = [(k, [float(np.float32(c)) for c in (axes[k % 6] * (1 + k % 9) + rng.standard_normal(6) * 0.02)], (k % 6) % 3) for k in range(1200)]
    frame = negatives.prepared(negatives.whole(vectors(rows)), np.eye(6)).orderBy("near", "closest")
    anchors = negatives.Anchors.of(frame.where("vec_id % 50 = 0").toArrow())
    best = negatives.Best(len(anchors.ids), 5)
    everything = np.tile(np.array([negatives.NOTHING + 1, negatives.NO_ID - 1]), (len(anchors.ids), 1, 1))
    told = negatives._scan(iter(frame.drop("near", "closest").toArrow().combine_chunks().to_batches()), anchors, True, everything, best)
    assert told[2] < told[0] / 3
    assert sorted(map(tuple, negatives.mined(vectors(rows)).collect()), key=str) == brute_negatives(rows)


def test_bounds_hold_for_all_pairs():
    rng = np.random.default_rng(9)
    for d in (1, 2, 5, 64):
        x = np.floor(rng.standard_normal((150, d)) * rng.choice([1, 40, 3000], (150, 1)))
        x[:5] = 0
        x[5:10] = -x[10:15]
        refs = negatives._units(np.vstack([x[10:14], rng.standard_normal((4, d))]))
        angles, norms = negatives._angles(x, refs), np.linalg.norm(x, axis=1)
        low, high = negatives.interval(angles, norms, angles, norms)
        exact = negatives.scores(x, x)
        assert (low <= exact).all() and (exact <= high).all()
        down, up = negatives.block_interval(angles[20:50], norms[20:50], angles, norms)
        assert (down <= exact[20:50].min(axis=0)).all() and (up >= exact[20:50].max(axis=0)).all()
        assert (negatives._pairwise(x, x[::-1]) == (x.astype(int) * x[::-1].astype(int)).sum(axis=1)).all()
    big = np.full((1, 4), 2.0**31 - 1)
    assert negatives.scores(np.full((1, 1), 2.0**30), np.full((1, 1), 2.0**30))[0, 0] == 1 << 60
    with pytest.raises(OverflowError):
        negatives.scores(big, big)


def test_negatives_of_little(vectors):
    assert negatives.mined(vectors([])).collect() == []
    assert negatives.mined(vectors([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)])).collect() == []  # no anchor
    assert negatives.mined(vectors([(50, [1.0, 2.0], 0)])).collect() == []
    assert negatives.mined(vectors([(50, [0.0], 0), (51, [0.0], 0), (52, [0.0], 1)])).collect() == [(50, 51, 1, 52, 0, 0)]
    with pytest.raises(Exception, match="beyond 32 bits"):
        negatives.mined(vectors([(1, [1e30, 2.0], 0), (2, [1.0, 2.0], 1)]))


def test_hard_negatives_query_equals_its_sql(spark):
    import os

    import duckdb

    from tallyspan.llm import queries

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    want = c.execute(queries.oracle_sql()["op11_hard_negatives"])
    names = [d[0] for d in want.description]
    got = queries.queries()["op11_hard_negatives"](spark, "/root/testdata/sf0.01")
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
