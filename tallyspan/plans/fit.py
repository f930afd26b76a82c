"""Fitting: one order of all observations, contiguous blocks for every number of clusters, all their coarsenings, and the best by BIC.

The loops run on the driver, each step over all rows as a Spark job; what comes back is a few numbers a step. All numbers of
clusters, samples and candidates are fitted together, so a pass over the rows serves all of them.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.exact import exact_sums
from tallyspan.operators import chain as C
from tallyspan.operators import checks
from tallyspan.operators import mixture as M
from tallyspan.operators import replay as V
from tallyspan.operators import selection as S
from tallyspan.plans import blocks as B
from tallyspan.plans.ranks import ranked
from tallyspan.plans.scratch import store

GRID, ROUNDS, GAP = 257, 100, 1e-6
MOST_CLUSTERS = 10
STRETCHES = 1024  # equal parts of the chain that the first blocks are made of
WEIGHT_GAP = 1e-8


#: What weights of candidates may still gain, in mean log likelihood, when they are compared.
SEARCH_GAP = 1e-7


@dataclass
class Fit:
    """Clusters by falling fraction, of equal ones the block that comes first: centers and weights; cuts of the chain in rising order of the pilot, and labels: the cluster of each block. Centers
    need not fall along the chain.

    requested: for how many clusters it was the best; parent_k, parent_rep, kind: the partition that it is, or is a coarsening of. gap bounds what better weights could add to the mean log likelihood; settled tells that neither cuts
    nor centers of that partition moved any more.
    """

    k: int
    centers: list[float]
    weights: list[float]
    cuts: list[int]
    labels: list[int]
    loglik: float
    conditional: float
    bic: float
    n: int
    gap: float
    settled: bool
    requested: int
    parent_k: int
    parent_rep: int
    kind: str


NEEDED = B.NEEDED
_sums = B.summed


def logliks(alt: np.ndarray, depth: np.ndarray, major: np.ndarray, den: np.ndarray, const: np.ndarray, cps: np.ndarray) -> np.ndarray:
    """Rows x cps: the log likelihood of prepared rows. cps: one set for all rows, or a row of its own for each."""
    alt, rest, den, const = (np.asarray(x, float)[:, None] for x in (alt, depth - alt, den, const))
    cps = np.broadcast_to(np.atleast_2d(cps), (len(alt), np.atleast_2d(cps).shape[1]))
    terms = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for m in range(1, int(major.max(initial=0)) + 1):
            has = slice(None) if (major >= m).all() else np.flatnonzero(major >= m)
            p = np.minimum(1.0, cps[has] * (m / den[has]))
            left = rest[has] * np.log1p(-p)
            left[rest[has][:, 0] == 0] = 0.0
            value = alt[has] * np.log(p)
            value[alt[has][:, 0] == 0] = 0.0
            terms.append((has, value + left))
        top = np.full(cps.shape, -np.inf)
        for has, value in terms:
            top[has] = np.maximum(top[has], value)
        shift = np.where(np.isneginf(top), 0.0, top)
        total = np.zeros(cps.shape)
        for has, value in terms:
            total[has] += np.exp(value - shift[has])
        return np.log(total) + shift + const


def loglik_array(cps: list[float]) -> Column:
    """Array column of a prepared row's log likelihoods at fixed fractions. In numpy: a whole grid costs less so than expression by expression."""

    @F.pandas_udf("array<double>")
    def at(alt: pd.Series, depth: pd.Series, major: pd.Series, den: pd.Series, const: pd.Series) -> pd.Series:
        columns = [c.to_numpy() for c in (alt, depth, major, den, const)]
        parts = [logliks(*(c[k : k + 2000] for c in columns), np.array(cps)) for k in range(0, len(alt), 2000)]
        return pd.Series([row for p in parts for row in p], dtype=object)

    return at(*NEEDED)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    column = b.column(b.schema.names.index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nonnegative_minimum(a: np.ndarray, c: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises x'ax / 2 - c'x, by an active set: entries that reach 0 are fixed there, the one that would gain most is freed."""
    a = a + 1e-10 * np.trace(a) / len(a) * np.eye(len(a))
    x, free = start.copy(), start > 0
    for _ in range(20 * len(c)):
        while free.any():
            at = np.flatnonzero(free)
            z = np.linalg.solve(a[np.ix_(at, at)], c[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            down = z <= 0
            step = (x[at][down] / (x[at][down] - z[down])).min()
            x[at] += step * (z - x[at])
            gone = at[down & (x[at] <= 1e-14)]
            if not len(gone):
                gone = at[down][[np.argmin(x[at][down])]]
            x[gone], free[gone] = 0, False
        slope = c - a @ x
        slope[free] = -np.inf
        if slope.max() <= 1e-10:
            break
        free[slope.argmax()] = True
    return x


class Weights:
    """Mixture weights on their way to the maximum: quadratic models of the mean log likelihood, steps halved until it rises.

    advance() takes the sums over all rows at self.at, and sets self.at to where they are needed next.
    """

    def __init__(self, start: np.ndarray):
        self.at = np.array(start, float) / np.sum(start)
        self.weights, self.value, self.gap, self.step = self.at, -math.inf, math.inf, 0.0
        self.aim = self.at

    def advance(self, mean: float, score: np.ndarray, square: np.ndarray) -> None:
        """mean log likelihood; means of each component's share by its weight; means of the products of two of these."""
        if self.value == -math.inf or (np.isfinite(mean) and mean >= self.value):
            self.weights, self.value, self.gap, self.step = self.at, mean, float(score.max()) - 1, 1.0
            self.aim = nonnegative_minimum(square, 2 * score - 1, self.weights)
            self.aim = self.aim / self.aim.sum()
        else:
            self.step /= 2
        self.at = self.weights + self.step * (self.aim - self.weights)

    def done(self, gap: float) -> bool:
        return self.gap <= gap or (0 < self.step < 1e-6)


def _moments(like: np.ndarray, top: np.ndarray, freq: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums for Weights.advance: n, log likelihood, scores, and products of scores."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = like @ w
        share = like / mass[:, None]
        return np.concatenate([[freq.sum(), freq @ (np.log(mass) + top)], freq @ share, (share.T @ (share * freq[:, None])).ravel()])


def _advance(weights: Weights, sums: np.ndarray) -> None:
    q, mean = len(weights.at), sums / sums[0]
    weights.advance(float(mean[1]), mean[2 : q + 2], mean[q + 2 :].reshape(q, q))


def pilot(obs: DataFrame, purity: float, points: int = GRID, rounds: int = ROUNDS, gap: float = GAP) -> DataFrame:
    """Prepared observations with pilot, the posterior mean fraction under the grid mixture that fits all of them best.

    Likelihoods on the grid are computed once and stored, relative to each row's largest, in single precision; each round is one pass
    that sums `points` squared numbers a task. The mean log likelihood is within `gap` of its maximum once no grid point's score
    exceeds 1 by more; if `rounds` end before that, a warning says so.
    """
    grid = np.linspace(0.0, purity, points)

    @F.pandas_udf("binary")
    def relative(alt: pd.Series, depth: pd.Series, major: pd.Series, den: pd.Series, const: pd.Series) -> pd.Series:
        columns, out = [c.to_numpy() for c in (alt, depth, major, den, const)], []
        for k in range(0, len(alt), 2000):
            like = logliks(*(c[k : k + 2000] for c in columns), grid)
            out += [row.tobytes() for row in np.exp(like - like.max(axis=1, keepdims=True)).astype(np.float32)]
        return pd.Series(out, dtype=object)

    def matrix(rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, points).astype(float)

    ready = store(M.prepared(obs, purity).withColumn("_l", relative(*NEEDED)), "grid", codec="lz4")
    found = Weights(np.full(points, 1.0 / points))
    for _ in range(0 if ready.isEmpty() else rounds):
        w = found.at

        def score(b: pa.RecordBatch) -> np.ndarray:
            like = matrix(b.column(b.schema.names.index("_l")).to_pylist())
            return _moments(like, np.zeros(len(like)), b.column(b.schema.names.index("freq")).to_numpy(), w)

        _advance(found, _sums(ready, ["_l", "freq"], score))
        if found.done(gap):
            break
    if found.gap > gap and found.value > -math.inf:
        warnings.warn(f"the pilot mixture ended {found.gap:.1e} from its optimum", stacklevel=2)
    w = found.weights

    @F.pandas_udf("double")
    def mean(rows: pd.Series) -> pd.Series:
        like = matrix(rows)
        return pd.Series(np.clip(like @ (w * grid) / (like @ w), 0.0, purity))

    return ready.withColumn("pilot", mean("_l")).drop("_l")


def _by_block(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch's columns in chain order, so that blocks are slices."""
    columns = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(b.schema.names)}
    order = np.argsort(columns["rank"], kind="stable")
    return {n: c[order] for n, c in columns.items()}


def _block_sums(chain: DataFrame, cuts: list[list[int]], points: list[np.ndarray], purity: float) -> list[np.ndarray]:
    """For each partition, given by its cuts, blocks x points: the log likelihood of a block at its points.

    points: for each partition blocks x points, or one row for all blocks. One pass, whatever the number of partitions.
    """
    shared = all(p is points[0] for p in points) and len(points[0]) == 1
    shapes = [(len(c) + 1, p.shape[1]) for c, p in zip(cuts, points, strict=True)]

    def sums(b: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(s) for s in shapes]
        rows = _by_block(b)
        for k in range(0, len(rows["rank"]), 2000):
            some = {n: c[k : k + 2000] for n, c in rows.items()}
            like = logliks(*(some[n] for n in NEEDED), points[0][0]) if shared else None
            for own, cut, at in zip(out, cuts, points, strict=True):
                edges = [0, *np.searchsorted(some["rank"], cut), len(some["rank"])]
                for j in range(len(own)):
                    part = slice(edges[j], edges[j + 1])
                    if part.start < part.stop:
                        here = like[part] if shared else logliks(*(some[n][part] for n in NEEDED), at[j % len(at)])
                        own[j] += some["freq"][part] @ here
        return np.concatenate([o.ravel() for o in out])

    flat, out, start = _sums(chain, ["rank", "freq", *NEEDED], sums), [], 0
    for s in shapes:
        out.append(flat[start : start + s[0] * s[1]].reshape(s))
        start += s[0] * s[1]
    return out


def refit(chain: DataFrame, purity: float, cuts: list[list[int]], around: list[np.ndarray] | None = None, zooms: int = 1, points: int = 33) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(centers, log likelihoods) of each partition's blocks: the best of the whole grid, or of two of its steps around given centers,
    then of finer ones around that. A pass over the rows for each of these, for all partitions together. Of equal ones the smallest."""

    def top(at: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        picks = [v.argmax(axis=1) for v in values]
        return [np.take_along_axis(np.broadcast_to(a, v.shape), p[:, None], 1)[:, 0] for a, v, p in zip(at, values, picks, strict=True)], [v.max(axis=1) for v in values]

    best, width, offsets = [], 2 * purity / (GRID - 1), np.linspace(-1, 1, points)
    if around is None:
        at = [np.linspace(0.0, purity, GRID)[None, :]] * len(cuts)
        around, best = top(at, _block_sums(chain, cuts, at, purity))
    for _ in range(zooms):
        at = [np.clip(c[:, None] + offsets * width, 0.0, purity) for c in around]
        around, best = top(at, _block_sums(chain, cuts, at, purity))
        width *= 2.5 / (points - 1)
    return around, best


def first_blocks(chain: DataFrame, purity: float, total: int, most: int) -> tuple[list[list[int]], list[np.ndarray]]:
    """(cuts, centers) of the best 1..most blocks that are made of whole stretches of the chain and have centers on the grid.

    A pass sums the likelihoods of each stretch on the grid; of a chain of any length STRETCHES x GRID numbers come back, on which the
    best blocks are searched in full.
    """
    grid, n = np.linspace(0.0, purity, GRID), min(STRETCHES, total)
    edges = [total * j // n for j in range(n + 1)]
    inner = edges[1:-1]

    def sums(b: pa.RecordBatch) -> np.ndarray:
        out, rows = np.zeros((n, 2, GRID)), _by_block(b)
        for k in range(0, len(rows["rank"]), 2000):
            some = {name: c[k : k + 2000] for name, c in rows.items()}
            like = logliks(*(some[name] for name in NEEDED), grid)
            never = np.isneginf(like)
            which = np.searchsorted(inner, some["rank"], side="right")
            first = np.flatnonzero(np.diff(which, prepend=-1))
            freq = some["freq"][:, None]
            out[which[first], 0] += np.add.reduceat(np.where(never, 0.0, like) * freq, first)
            out[which[first], 1] += np.add.reduceat(never * freq, first)
        return out.ravel()

    upto = np.concatenate([np.zeros((1, 2, GRID)), _sums(chain, ["rank", "freq", *NEEDED], sums).reshape(n, 2, GRID).cumsum(axis=0)])

    def at_grid(i, j):
        return np.where(upto[j, 1] > upto[i, 1], -np.inf, upto[j, 0] - upto[i, 0])

    gain = np.full((n + 1, n + 1), -np.inf)  # of one block from stretch i up to j
    for i in range(n):
        gain[i, i + 1 :] = at_grid(i, slice(i + 1, None)).max(axis=1)
    state, back, found = gain[0].copy(), [], [[0, n]]
    for k in range(2, min(most, n) + 1):
        paths = state[:, None] + gain
        back.append(paths.argmax(axis=0))
        state = paths.max(axis=0)
        ends = [n]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        found.append([0, *reversed(ends)])
    centers = [np.array([grid[at_grid(i, j).argmax()] for i, j in zip(f, f[1:], strict=False)]) for f in found]
    return [[edges[e] for e in f[1:-1]] for f in found], centers


def mixture_weights(obs: DataFrame, centers: list[list[float]], start: list[list[float]], rounds: int = ROUNDS, gap: float = WEIGHT_GAP) -> list[tuple[list[float], float, float]]:
    """(weights, log likelihood, gap) for each list of fixed centers. The likelihoods of all different centers are stored once; the log likelihood is within n * gap of its maximum."""
    every = sorted({c for each in centers for c in each})
    place = {c: k for k, c in enumerate(every)}
    columns = [np.array([place[c] for c in each]) for each in centers]
    ready = store(obs.select("freq", loglik_array(every).alias("t")), "weights", codec="lz4")
    found = [Weights(np.array(s, float)) for s in start]
    for _ in range(rounds):
        todo = [k for k, f in enumerate(found) if not f.done(gap)]
        if not todo:
            break
        at = {k: found[k].at for k in todo}

        def step(b: pa.RecordBatch) -> np.ndarray:
            like, freq = _matrix(b, "t"), b.column(b.schema.names.index("freq")).to_numpy().astype(float)
            top = like.max(axis=1)
            scaled, out = np.exp(like - top[:, None]), []
            for k, w in at.items():
                own, base = scaled[:, columns[k]], top
                if (low := np.flatnonzero(own.max(axis=1) < 1e-200)).size:  # far below the best of all centers
                    base = top.copy()
                    base[low] = like[np.ix_(low, columns[k])].max(axis=1)
                    own[low] = np.exp(like[np.ix_(low, columns[k])] - base[low, None])
                out.append(_moments(own, base, freq, w))
            return np.concatenate(out)

        flat, begin = _sums(ready, ["t", "freq"], step), 0
        for k in todo:
            size = 2 + len(at[k]) + len(at[k]) ** 2
            n = flat[begin]
            _advance(found[k], flat[begin : begin + size])
            begin += size
    return [(f.weights.tolist(), f.value * float(n), f.gap) for f in found]


def alternate(chain: DataFrame, purity: float, cuts: list[list[int]], centers: list[np.ndarray], rounds: int = 50, gain: float = 1e-9) -> tuple[list[list[int]], list[bool]]:
    """(cuts, settled). cuts and centers: where each partition starts. Alternates block centers and the best blocks for them, none empty, for all partitions together, until no likelihood rises by more than
    `gain` of itself."""
    cuts, settled = [list(c) for c in cuts], [len(c) == 0 for c in cuts]
    centers, values = refit(chain, purity, cuts, centers)
    for _ in range(rounds):
        todo = [k for k, done in enumerate(settled) if not done]
        if not todo:
            break
        flat = np.array([float(c) for k in todo for c in centers[k]])

        def scores(b: pa.RecordBatch, flat=flat) -> np.ndarray:
            columns = [b.column(k).to_numpy() for k in range(1, b.num_columns)]
            return logliks(*columns[1:], flat) * columns[0][:, None]

        found = C.ordered_scan(chain, ["freq", *NEEDED], scores, [len(centers[k]) for k in todo])
        for k, (_, new) in zip(todo, found, strict=True):
            if new == cuts[k]:
                settled[k] = True
            else:
                cuts[k] = new
        todo = [k for k in todo if not settled[k]]
        if not todo:
            break
        at, new_values = refit(chain, purity, [cuts[k] for k in todo], [centers[k] for k in todo])
        for k, c, v in zip(todo, at, new_values, strict=True):
            settled[k] = bool(v.sum() - values[k].sum() <= gain * abs(v.sum()))
            centers[k], values[k] = c, v
    return cuts, settled


def merged(cuts: list[int], centers: list[float], values: list[float], sizes: list[float]) -> tuple[list[int], list[float], list[float], list[float]]:
    """A partition whose neighbouring blocks have different centers: equal neighbours are one block."""
    out_cuts, c, v, n = [], [centers[0]], [values[0]], [sizes[0]]
    for cut, center, value, size in zip(cuts, centers[1:], values[1:], sizes[1:], strict=True):
        if center == c[-1]:
            v[-1], n[-1] = v[-1] + value, n[-1] + size
        else:
            out_cuts.append(cut)
            c, v, n = [*c, center], [*v, value], [*n, size]
    return out_cuts, c, v, n


def falling(centers: list[float]) -> tuple[list[int], list[int]]:
    """(blocks by falling center, of equal ones the first one first; the place of each block among them)."""
    order = sorted(range(len(centers)), key=lambda b: (-centers[b], b))
    return order, [order.index(b) for b in range(len(centers))]


def scored(chain: DataFrame, purity: float, total: int, partitions_: list[list[int]], gap: float = WEIGHT_GAP, surely: bool = True, settled: list[bool] | None = None) -> list[Fit]:
    """Each partition, given by its cuts, with its refitted centers, best weights and BIC. Every stretch that any of them has as a block is searched once, however many partitions share it."""
    spans = sorted({span for cuts in partitions_ for span in zip([0, *cuts], [*cuts, total], strict=True)})
    told = dict(zip(spans, zip(*B.refit(chain, purity, spans, surely), strict=True), strict=True))
    kept = []
    for cuts in partitions_:
        parts = [told[span] for span in zip([0, *cuts], [*cuts, total], strict=True)]
        kept.append(merged(cuts, *map(list, zip(*parts, strict=True))))
    out = []
    for (cuts, centers, values, sizes), (weights, value, left), given, sure in zip(kept, mixture_weights(chain, [k[1] for k in kept], [k[3] for k in kept], gap=gap), partitions_, settled or [True] * len(kept), strict=True):
        q, n = len(centers), int(sum(sizes))
        order, labels = falling(centers)
        out.append(Fit(q, [centers[b] for b in order], [weights[b] for b in order], cuts, labels, value, math.fsum(values), -2 * value + (2 * q - 1) * math.log(n), n, left, sure, len(given) + 1, len(given) + 1, 1, "native"))
    return out


def partitions(chain: DataFrame, purity: float, cuts: list[list[int]], centers: list[np.ndarray]) -> list[Fit]:
    """The partitions that alternate() ends in, without their coarsenings."""
    cuts, settled = alternate(chain, purity, cuts, centers)
    return scored(chain, purity, chain.count(), cuts, settled=settled)


PARENTS = "requested_k long, replicate long, cuts array<long>"


def search(chain: DataFrame, purity: float, total: int, parents: list[tuple[int, int, list[int]]], budgets: list[int], settled: dict[tuple[int, int], bool] | None = None) -> tuple[list[Fit], DataFrame]:
    """(the best fit of each budget, all candidates). parents: (requested_k, replicate, cuts).

    Candidates are the parents and all their coarsenings, each scored; only those whose components all have weight can win. A budget without any takes the best of what its parents can be merged to, down to a single block. The
    winners' centers are searched once more with B.certain() and their weights to WEIGHT_GAP.
    """
    spark = chain.sparkSession
    most = max([len(cuts) + 1 for _, _, cuts in parents] + budgets)
    bank = S.coarsenings(spark.createDataFrame([(k, rep, [int(c) for c in cuts]) for k, rep, cuts in parents], PARENTS), list(range(1, most + 1))).collect()  # at most 2^9 a parent
    every = sorted({tuple(r["cuts"]) for r in bank}, key=lambda c: (len(c), c))
    fits_ = dict(zip(every, scored(chain, purity, total, [list(c) for c in every], SEARCH_GAP, surely=False), strict=True))
    whole = [(r["budget"], tuple(r["cuts"]), r["parent_k"], r["parent_rep"], r["kind"]) for r in bank]
    able = lambda c: min(fits_[c].weights) > 0
    rows = [w for w in whole if w[0] in budgets]
    for budget in budgets:
        if not any(w[0] == budget and able(w[1]) for w in rows):
            rows += [(budget, c, k, rep, "repaired") for b, c, k, rep, _ in whole if b <= budget and able(c)]
    rows.sort(key=lambda w: (w[0], w[4] != "native", w[2], w[3], w[1]))
    table = [(i, b, len(fits_[c].centers), fits_[c].bic, kind, k, rep, list(c), able(c), fits_[c].loglik, fits_[c].conditional, fits_[c].gap) for i, (b, c, k, rep, kind) in enumerate(rows)]
    candidates = spark.createDataFrame(table, "candidate_id long, budget long, q long, bic double, kind string, parent_k long, parent_rep long, cuts array<long>, eligible boolean, loglik double, conditional double, gap double")
    won = S.winners(candidates.where("eligible"))
    picked = {r["budget"]: rows[r["candidate_id"]] for r in won.collect()}
    final = scored(chain, purity, total, [list(w[1]) for w in picked.values()])
    for f, (budget, _, k, rep, kind) in zip(final, picked.values(), strict=True):
        f.requested, f.parent_k, f.parent_rep, f.kind, f.settled = budget, k, rep, kind, (settled or {}).get((k, rep), True)
    return sorted(final, key=lambda f: f.requested), S.flagged(candidates, won)


def chained(rows: DataFrame, purity: float) -> DataFrame:
    """Distinct observations of rows in chain order: prepared, with freq, pilot and rank from 0, stored by ranges of ranks."""
    found = store(pilot(M.observations(rows), purity), "pilot", codec="lz4")
    return C.in_ranges(ranked(found, [F.col("pilot"), *map(F.col, M.KEY)], "rank", 0), found.count())


def sampled_parents(rows: DataFrame, chain: DataFrame, purity: float, size: int, replicates: int, seed: int, window: float, overlap: float, most: int, only: int | None) -> list[tuple[int, int, list[int], bool]]:
    """(requested_k, replicate, cuts of the whole chain, settled): partitions fitted to samples of rows, stratified by the share of alternate reads, and carried over to the whole chain."""
    drawn = store(S.window_samples(rows, F.col("alt_count") / F.col("depth"), size, seed, replicates, window, overlap), "samples")
    out = []
    for rep in range(1, replicates + 1):
        own = M.observations(drawn.where(F.col("replicate") == rep)).withColumnRenamed("freq", "own")
        part = chain.join(own, list(M.KEY)).withColumn("full_rank", F.col("rank")).withColumn("freq", F.col("own")).drop("own", "rank")
        count = part.count()
        part = C.in_ranges(ranked(part, [F.col("full_rank")], "rank", 0), count)
        cuts, centers = first_blocks(part, purity, count, only or most)
        if only:
            cuts, centers = cuts[-1:], centers[-1:]
        cuts, settled = alternate(part, purity, cuts, centers)
        for c, sure in zip(cuts, settled, strict=True):
            ends = S.boundaries(C.labelled(part.select("rank", "full_rank"), c).select("block", F.col("full_rank").alias("rank")))
            out.append((len(c) + 1, rep, sorted(r["cut"] for r in ends.collect()), sure))
    return out


def fits(rows: DataFrame, purity: float, most: int = MOST_CLUSTERS, only: int | None = None, sampling: dict | None = None) -> tuple[DataFrame, list[Fit], DataFrame]:
    """(chain, the best fit for each of 1..most clusters, or as many as there are distinct observations, all candidates). None is left out for its BIC.

    only: fit this number of clusters alone. sampling: size, replicates, seed, window and overlap, if the partitions are to come from samples; they are scored on all rows all the same.
    """
    chain = chained(rows, purity)
    total = chain.count()
    if only and total < only:
        raise ValueError(f"{total} distinct observations cannot make {only} clusters")
    if sampling:
        found = sampled_parents(rows, chain, purity, most=most, only=only, **sampling)
    else:
        cuts, centers = first_blocks(chain, purity, total, only or most)
        if only:
            cuts, centers = cuts[-1:], centers[-1:]
        cuts, settled = alternate(chain, purity, cuts, centers)
        found = [(len(c) + 1, 1, c, sure) for c, sure in zip(cuts, settled, strict=True)]
    budgets = [only] if only else list(range(1, min(most, total) + 1))
    out, candidates = search(chain, purity, total, [f[:3] for f in found], budgets, {(k, rep): sure for k, rep, _, sure in found})
    if late := [f.requested for f in out if not f.settled or f.gap > WEIGHT_GAP]:
        warnings.warn(f"not settled: fits of {late} clusters", stacklevel=2)
    return chain, out, candidates


def best(found: list[Fit]) -> Fit:
    """The least BIC among fits without components of weight 0, if there are any; then the fewest clusters, then the least request."""
    return min(found, key=lambda f: (min(f.weights) <= 0, f.bic, f.k, f.requested))


def exactly(chain: DataFrame, fit: Fit, purity: float) -> None:
    """Sets the fit's log likelihood and BIC to exact sums over the rows, rounded once: they depend on centers and weights only, not on how the rows are dealt."""
    member = M.memberships(chain, purity, fit.centers, fit.weights)
    fit.loglik = exact_sums(member, [], loglik=F.col("freq") * F.col("mix")).first()["total"]
    fit.bic = -2 * fit.loglik + (2 * fit.k - 1) * math.log(fit.n)


def label_of(labels: list[int], block: Column) -> Column:
    """The cluster of a block of the chain, labels being those of all blocks."""
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in labels]), block.cast("int") + 1)


def tables(rows: DataFrame, chain: DataFrame, fit: Fit, purity: float) -> dict[str, DataFrame]:
    """The published tables: mutations with cluster and multiplicity, and clusters, cluster 0 the largest fraction."""
    label = C.labelled(chain, fit.cuts).select(*M.KEY, label_of(fit.labels, F.col("block")).alias("cluster_index"))
    at = F.element_at(F.array(*[F.lit(c) for c in fit.centers]), F.col("cluster_index").cast("int") + 1)
    named = rows.join(label, list(M.KEY)).withColumn("cp", at)
    called = named.join(M.calls(named, purity, F.col("cp")), "original_row")
    mutations = called.select("chrom", "pos", "mutation_id", "original_row", "cluster_index", "major_cn", "multiplicity", "expected_multiplicity", "multiplicity_probability")
    sizes = named.groupBy("cluster_index").agg(F.count("*").alias("num_SNV"), F.first("cp").alias("cellular_prevalence"))
    total = fit.n
    clusters = sizes.select("cluster_index", "num_SNV", "cellular_prevalence", (F.col("cellular_prevalence") / purity).alias("cancer_cell_fraction"), F.lit(purity).alias("purity"), (F.col("num_SNV") / F.lit(total)).alias("assignment_proportion"))
    return {"mutations": mutations, "clusters": clusters}


def posterior_tables(rows: DataFrame, chain: DataFrame, fit: Fit, purity: float) -> dict[str, DataFrame]:
    """What the mixture says beside the published labels: components, flow from labels to components, one summary row, and a row per mutation."""
    label = label_of(fit.labels, F.col("block"))
    blocks = store(C.labelled(chain, fit.cuts).withColumn("label", label), "blocks", codec="lz4")
    member = store(M.memberships(blocks, purity, fit.centers, fit.weights), "member", codec="lz4")
    summary = M.summary(member, F.col("label"), fit.centers, purity)
    summary = summary.join(F.broadcast(V.allocation_distance(member, F.col("label"), fit.k)), "n").join(F.broadcast(V.fit_arithmetic(member, [w or math.inf for w in fit.weights])), "n")  # one row each
    each = V.posterior_mutations(blocks.withColumn("original_row", F.col("rank")), F.col("label"), fit.centers, fit.weights, purity)
    each = each.withColumnRenamed("original_row", "rank").join(blocks.select("rank", *M.KEY), "rank").drop("rank")
    return {
        "posterior_clusters": M.cumulative_mass(M.posterior_clusters(member, fit.centers, fit.weights, purity)).select("cluster_index", "mass_below").join(M.posterior_clusters(member, fit.centers, fit.weights, purity), "cluster_index"),
        "posterior_flow": M.flow(member, F.col("label"), fit.k),
        "posterior_summary": summary,
        "posterior_mutations": rows.select("original_row", *M.KEY).join(each, list(M.KEY)).drop(*M.KEY),
    }


def fit_table(spark, found: list[Fit]) -> DataFrame:
    """One row per number of clusters."""
    chosen = best(found)
    return spark.createDataFrame([(*(getattr(f, n) for n in FIT_COLUMNS), f is chosen) for f in found], "k long, centers array<double>, weights array<double>, cuts array<long>, labels array<long>, loglik double, conditional double, bic double, n long, gap double, settled boolean, requested long, parent_k long, parent_rep long, kind string, selected boolean")


FIT_COLUMNS = ("k", "centers", "weights", "cuts", "labels", "loglik", "conditional", "bic", "n", "gap", "settled", "requested", "parent_k", "parent_rep", "kind")


def faults(rows: DataFrame, published: dict[str, DataFrame], purity: float) -> DataFrame:
    """(rule, n) over the published tables of a run, rows being what its ledger retains: all 0 if the run is sound.

    Labels, calls and sizes are checked against the rows; likelihood, BIC and posterior tables are computed anew from the published centers and weights.
    """
    chosen = published["fits"].where("selected").first()
    fit = Fit(*(chosen[n] for n in FIT_COLUMNS))
    named = published["mutations"].select("original_row", F.col("cluster_index").alias("label")).join(rows, "original_row")
    obs = named.groupBy(*M.KEY, "label").agg(F.count("*").alias("freq"))
    member = store(M.memberships(obs, purity, fit.centers, fit.weights), "again", codec="lz4")
    sums = V.fit_arithmetic(member, [w or math.inf for w in fit.weights]).select("n", "loglik", "bic")
    told = published["fits"].where("selected").select("n", "loglik", "bic")
    again = {
        "fit": (sums, told, ("n",)),
        "posterior_clusters": (M.posterior_clusters(member, fit.centers, fit.weights, purity), published["posterior_clusters"].drop("mass_below"), ("cluster_index",)),
        "posterior_flow": (M.flow(member, F.col("label"), fit.k), published["posterior_flow"], ("chain_cluster_index", "posterior_cluster_index")),
        "posterior_summary": (M.summary(member, F.col("label"), fit.centers, purity), published["posterior_summary"].drop("total_variation", "count_gap", "loglik", "bic", "weight_gap"), ("n",)),
    }
    rules = [checks.cluster_rules(published["clusters"], published["mutations"], purity), checks.order_rules(published["clusters"]), checks.row_rules(published["mutations"], published["clusters"], rows, purity), checks.center_rules(published["clusters"], published["mutations"], rows, purity)]
    rules += [checks.far_apart(*tables).select(F.lit(name).alias("rule"), "n") for name, tables in again.items()]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out
