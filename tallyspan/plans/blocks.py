"""Centres of stretches of the chain: the fraction at which a stretch's summed log likelihood is largest.

Many stretches are searched together, so that a pass over the rows serves all of them. One pass sums the likelihoods of the pieces that the stretches' ends cut the chain into, on a grid; every stretch is a
run of pieces, so its values are sums of a few rows. Each local maximum on the grid, and each end of it, brackets a search by safeguarded Newton steps: a pass gives value, slope and curvature at
one point of every open bracket. What a grid can miss is looked for by certain(): a pass gives an upper bound for each stretch in each cell of the grid, and only cells whose bound exceeds the
best value found are cut finer and united with the modes of the rows' components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEEDED = ("alt_count", "depth", "major_cn", "den", "const")
POINTS = 513
#: A bracket is closed once its next step is no longer than this or adds less than LEFT a row; parts that an open cell is cut into; steps of a search at most.
STEP, LEFT, PARTS, STEPS = 1e-12, 1e-17, 8, 80
#: Rows that are turned into matrices at once.
CHUNK = 2000


def summed(rows: DataFrame, columns: list, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over tasks of of(batch), an array of doubles. Tasks leave out zeros, all but the last one."""

    def part(batches):
        total = None
        for b in batches:
            if b.num_rows:
                one = of(b)
                total = one if total is None else total + one
        if total is not None:
            told = np.union1d(np.flatnonzero(total), [len(total) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(total[told])], names=["i", "v"])

    got = rows.select(*columns).mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    at = got["i"].to_numpy()
    out = np.zeros(at.max(initial=-1) + 1)
    out[at] = got["v"].to_numpy()
    return out


def components(alt: np.ndarray, depth: np.ndarray, major: np.ndarray, den: np.ndarray, const: np.ndarray, cps: np.ndarray):
    """For m = 1, 2, ...: (m, rows that have m, their log likelihoods with m copies at cps, chances of a read). cps: a row for all, or one for each."""
    cps = np.broadcast_to(np.atleast_2d(cps), (len(alt), np.atleast_2d(cps).shape[1]))
    for m in range(1, int(major.max(initial=0)) + 1):
        has = np.flatnonzero(major >= m)
        a, rest = alt[has, None].astype(float), (depth - alt)[has, None].astype(float)
        p = np.minimum(1.0, cps[has] * (m / den[has, None]))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(a == 0, 0.0, a * np.log(p)) + np.where(rest == 0, 0.0, rest * np.log1p(-p)) + const[has, None]
        yield m, has, value, p


def curves(alt, depth, major, den, const, cps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x cps: log likelihood, its slope and its second derivative by the fraction. Where a row is impossible, slope and curvature are 0."""
    parts = list(components(alt, depth, major, den, const, cps))
    shape = (len(alt), np.atleast_2d(cps).shape[1])
    top = np.full(shape, -np.inf)
    for _, has, value, _ in parts:
        top[has] = np.maximum(top[has], value)
    shift = np.where(np.isneginf(top), 0.0, top)
    mass, slope, bend = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for m, has, value, p in parts:
        w = np.exp(value - shift[has])
        a, rest, step = alt[has, None].astype(float), (depth - alt)[has, None].astype(float), m / den[has, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(p < 1, (np.where(a == 0, 0.0, a / p) - rest / (1 - p)) * step, 0.0)
            h = np.where(p < 1, -(np.where(a == 0, 0.0, a / p**2) + rest / (1 - p) ** 2) * step**2, 0.0)
            mass[has] += w
            slope[has] += np.where(w > 0, w * g, 0.0)
            bend[has] += np.where(w > 0, w * (h + g * g), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(mass) + shift
        g = np.where(mass > 0, slope / mass, 0.0)
        h = np.where(mass > 0, bend / mass - g * g, 0.0)
    return value, g, h


def ceilings(alt, depth, major, den, const, grid: np.ndarray) -> np.ndarray:
    """Rows x cells between neighbours of the grid: no less than the log likelihood anywhere in the cell. Each component is concave, so its largest value is at an end or at its mode."""
    total = np.full((len(alt), len(grid) - 1), -np.inf)
    for m, has, value, _ in components(alt, depth, major, den, const, grid):
        most = np.maximum(value[:, :-1], value[:, 1:])
        mode = np.clip(alt[has] / depth[has] * den[has] / m, grid[0], grid[-1])
        cell = np.clip(np.searchsorted(grid, mode, side="right") - 1, 0, len(grid) - 2)
        a, rest = alt[has].astype(float), (depth - alt)[has].astype(float)
        p = np.minimum(1.0, mode * (m / den[has]))
        with np.errstate(divide="ignore", invalid="ignore"):
            best = np.where(a == 0, 0.0, a * np.log(p)) + np.where(rest == 0, 0.0, rest * np.log1p(-p)) + const[has]
        at = np.arange(len(has))
        most[at, cell] = np.maximum(most[at, cell], best)
        total[has] = np.logaddexp(total[has], most)
    return total


def _slices(b: pa.RecordBatch, edges: list[int]):
    """Chunks of a batch in the order of ranks: columns by name, and where the pieces of the chain begin in it."""
    columns = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(b.schema.names)}
    if len(columns["rank"]) and (np.diff(columns["rank"]) < 0).any():
        order = np.argsort(columns["rank"], kind="stable")
        columns = {n: c[order] for n, c in columns.items()}
    for k in range(0, b.num_rows, CHUNK):
        some = {n: c[k : k + CHUNK] for n, c in columns.items()}
        yield some, np.searchsorted(some["rank"], edges)


class Chain:
    """The chain's rows, and where the stretches that are asked for end. spans: (first rank, rank after the last) of each stretch."""

    def __init__(self, rows: DataFrame, purity: float, spans: list[tuple[int, int]]):
        self.rows, self.purity, self.spans = rows, purity, spans
        self.edges = sorted({e for s in spans for e in s})
        at = {e: k for k, e in enumerate(self.edges)}
        self.runs = [(at[i], at[j]) for i, j in spans]

    def by_piece(self, width: int, of: Callable[..., np.ndarray]) -> np.ndarray:
        """Pieces x width: the sums of of(rows), rows x width, times how often a row occurs."""
        edges, n = self.edges, len(self.edges) - 1

        def sums(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((n, width))
            for some, cut in _slices(b, edges):
                inside = slice(cut[0], cut[-1])
                if inside.start < inside.stop:
                    value = of(*(some[c][inside] for c in NEEDED)) * some["freq"][inside, None]
                    starts = np.flatnonzero(cut[1:] > cut[:-1])
                    out[starts] += np.add.reduceat(value, cut[starts] - cut[0])
            return out.ravel()

        flat = summed(self.rows, ["rank", "freq", *NEEDED], sums)
        return flat.reshape(n, width) if len(flat) else np.zeros((n, width))

    def of_spans(self, pieces: np.ndarray) -> list[np.ndarray]:
        return [pieces[i:j].sum(axis=0) for i, j in self.runs]

    def at(self, points: list[np.ndarray], curved: bool = False) -> list[np.ndarray]:
        """For each stretch its summed log likelihood at its own points; curved: 3 x points, with slope and curvature."""
        many = 3 if curved else 1
        ends, edges, runs = np.cumsum([0, *(many * len(p) for p in points)]), self.edges, self.runs

        def sums(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(ends[-1])
            for some, cut in _slices(b, edges):
                for k, ((i, j), p) in enumerate(zip(runs, points, strict=True)):
                    part = slice(cut[i], cut[j])
                    if len(p) and part.start < part.stop:
                        found = curves(*(some[c][part] for c in NEEDED), p)[:many] if curved else [value_of(*(some[c][part] for c in NEEDED), p)]
                        out[ends[k] : ends[k + 1]] += np.concatenate([some["freq"][part] @ f for f in found])
            return out

        flat = summed(self.rows, ["rank", "freq", *NEEDED], sums) if ends[-1] else np.zeros(0)
        return [flat[a:b].reshape(many, -1) if curved else flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def value_of(alt, depth, major, den, const, cps) -> np.ndarray:
    """Rows x cps: the log likelihood alone."""
    total = np.full((len(alt), np.atleast_2d(cps).shape[1]), -np.inf)
    for _, has, value, _ in components(alt, depth, major, den, const, cps):
        total[has] = np.logaddexp(total[has], value)
    return total


def maxima(values: np.ndarray) -> np.ndarray:
    """Inner places that no neighbour exceeds and at least one falls short of."""
    up, mid, down = values[:-2], values[1:-1], values[2:]
    return np.flatnonzero((mid >= up) & (mid >= down) & ((mid > up) | (mid > down))) + 1


class _Search:
    """Brackets of all stretches on their way; best: (value, -point) of each stretch, so that of equal values the smaller point counts."""

    def __init__(self, chain: Chain, best: list[tuple[float, float]], sizes: list[float]):
        self.chain, self.best, self.sizes, self.open = chain, best, sizes, []

    def bracket(self, k: int, low: float, high: float, start: float, edge: float | None = None) -> None:
        """edge: the end of low and high that is the end of all fractions, where a search may end."""
        self.open.append([k, low, high, start, edge, False])

    def run(self) -> None:
        for _ in range(STEPS):
            if not self.open:
                return
            points: list[list[float]] = [[] for _ in self.best]
            for o in self.open:
                points[o[0]].append(o[3])
            told = self.chain.at([np.array(p) for p in points], curved=True)
            seen, rest = [0] * len(self.best), []
            for o in self.open:
                k, low, high, x, edge, probed = o
                value, slope, bend = told[k][:, seen[k]]
                seen[k] += 1
                self.best[k] = max(self.best[k], (float(value), -x))
                slope = slope if value > -np.inf else -np.inf  # too large a fraction is what makes rows impossible
                low, high = (x, high) if slope > 0 else (low, x)
                if not slope or high - low <= STEP:
                    continue
                if edge is not None and edge in (low, high) and not probed:
                    nxt, probed = edge + (1e-7 if edge == low else -1e-7) * (high - low), True  # does it rise up to the end?
                elif edge is not None and probed and abs(x - edge) <= 1e-6 * abs(self.chain.purity) and edge in (low, high):
                    continue  # it does, and the end itself is on the grid
                else:
                    nxt = x - slope / bend if bend < 0 and np.isfinite(slope) else np.nan
                    if not low < nxt < high:
                        nxt = (low + high) / 2
                    if abs(nxt - x) <= STEP or (bend < 0 and -bend * (nxt - x) ** 2 <= 2 * LEFT * self.sizes[k]):
                        continue
                rest.append([k, low, high, float(nxt), edge, probed])
            self.open = rest


def refit(rows: DataFrame, purity: float, spans: list[tuple[int, int]], surely: bool = False) -> tuple[list[float], list[float], list[float]]:
    """(centres, log likelihoods, numbers of observations) of stretches of the chain. surely: with certain() as well."""
    if not spans:
        return [], [], []
    chain, grid = Chain(rows, purity, spans), np.linspace(0.0, purity, POINTS)
    pieces = chain.by_piece(POINTS + 1, lambda *c: np.hstack([value_of(*c, grid), np.ones((len(c[0]), 1))]))
    told = chain.of_spans(pieces)
    values, sizes = [t[:-1] for t in told], [float(t[-1]) for t in told]
    search = _Search(chain, [(float(v.max()), -float(grid[v.argmax()])) for v in values], sizes)
    for k, v in enumerate(values):
        for i in maxima(v):
            search.bracket(k, grid[i - 1], grid[i + 1], grid[i])
        search.bracket(k, grid[0], grid[1], (grid[0] + grid[1]) / 2, grid[0])
        search.bracket(k, grid[-2], grid[-1], (grid[-2] + grid[-1]) / 2, grid[-1])
    search.run()
    if surely:
        certain(search, grid, values)
    if bad := [chain.spans[k] for k, (v, _) in enumerate(search.best) if not np.isfinite(v)]:
        raise RuntimeError(f"no fraction is possible for all rows of ranks {bad[0]}")
    return [-x for _, x in search.best], [v for v, _ in search.best], sizes


def certain(search: _Search, grid: np.ndarray, values: list[np.ndarray]) -> None:
    """Looks into every cell of the grid that can hold more than the best so far: cut into PARTS, united with a mode for each part that holds any, and each new maximum among these that
    exceeds the best brackets one more search."""
    chain, cells, purity = search.chain, len(grid) - 1, search.chain.purity
    fine = cells * PARTS

    edges, n = chain.edges, len(chain.edges) - 1

    def modes(b: pa.RecordBatch) -> np.ndarray:
        count, total = np.zeros(n * fine), np.zeros(n * fine)
        for some, cut in _slices(b, edges):
            alt, depth, major, den = (some[c][cut[0] : cut[-1]] for c in NEEDED[:4])
            piece = np.searchsorted(edges, some["rank"][cut[0] : cut[-1]], side="right") - 1
            for m in range(1, int(major.max(initial=0)) + 1):
                mode = alt / depth * den / m
                has = np.flatnonzero((major >= m) & (mode < purity))
                at = piece[has] * fine + np.floor(mode[has] / purity * fine).astype(int)
                count += np.bincount(at, minlength=n * fine)
                total += np.bincount(at, mode[has], n * fine)
        return np.concatenate([count, total])

    upper = chain.of_spans(chain.by_piece(cells, lambda *c: ceilings(*c, grid)))
    flat = summed(chain.rows, ["rank", *NEEDED], modes)
    told = [np.concatenate([u, c, t]) for u, c, t in zip(upper, *(chain.of_spans(x.reshape(n, fine)) for x in np.split(flat if len(flat) else np.zeros(2 * n * fine), 2)), strict=True)]
    points = []
    for k, t in enumerate(told):
        wide = np.flatnonzero(t[:cells] > search.best[k][0])
        inner = np.linspace(grid[wide], grid[wide + 1], PARTS + 1)[1:-1].ravel()
        parts = (wide[:, None] * PARTS + np.arange(PARTS)).ravel()
        count, total = t[cells : cells + fine][parts], t[cells + fine :][parts]
        points.append(np.unique(np.concatenate([inner, total[count > 0] / count[count > 0]])))
    found = chain.at(points)
    for k, (p, v) in enumerate(zip(points, found, strict=True)):
        every, at = np.concatenate([grid, p]), np.concatenate([values[k], v])
        order = np.argsort(every, kind="stable")
        every, at = every[order], at[order]
        best = search.best[k][0]
        for i in maxima(at):
            if at[i] > best:
                search.best[k] = max(search.best[k], (float(at[i]), -float(every[i])))
                search.bracket(k, every[i - 1], every[i + 1], every[i])
    search.run()
