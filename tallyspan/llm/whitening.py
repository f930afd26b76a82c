"""Whitening of embeddings: leading principal directions by Chebyshev-filtered subspace iteration over distributed passes.

Every entry c becomes the integer x = floor(1024 * c) + 100000, so counts, sums, the trace of the covariance and each row's deviation are exact whole-number
arithmetic. The covariance V of x is never formed: a pass over the rows gives V Q = X'(X Q) / n for a block Q of a few directions, rows centred
before they are multiplied. A polynomial of V, built by the three-term recurrence of the Chebyshev polynomials on the unwanted part of the spectrum, is
applied to the block pass by pass; QR and Rayleigh-Ritz then give directions and variances, and their residuals |V q - e q| certify them. If the spectrum is so flat
that more than SLOW passes would be needed, the block is widened, at the latest to all dimensions, where one Rayleigh-Ritz step is exact.

Rows whose vector is null or has null or non-finite entries don't count. All others must have as many entries as the most frequent length among them
(ties: the longest); rows of another length, the empty vector included unless it is the most frequent, have no place in the covariance and are left out too. Null ids stay null; repeated rows
count as often as they occur; an empty table, or vectors without any variance, gives no rows. Directions whose variance is under RANK of the first one's are
none: there are fewer components then. Other columns are not looked at. Whole numbers that a long cannot hold raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Directions carried for each one wanted, the degree of a filter, and the residual, relative to the first variance, that certifies one.
WIDTH, DEGREE, CERTIFIED = 4, 8, 2e-14
ROUNDS, SLOW, RANK = 60, 80, 1e-12
#: Partial sums that are added up by one task, or by the driver.
FAN = 128
#: Rows that are turned into matrices at once.
CHUNK = 4096


@dataclass
class Whitening:
    """n rows with sums per dimension; directions (a row each) by falling variance; trace of V; residuals relative to the first variance; passes over the rows."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def whole(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that count, x their whole numbers as little-endian 64-bit binaries. Written to the shared folder once."""
    entries = F.col(f"`{embedding}`").cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    slim = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), entries.alias("c")).where(F.col("c").isNotNull() & good)
    found = slim.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    slim = slim.where(F.size("c") == (found["d"] if found else 0))
    kind = slim.schema["vec_id"].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scaled = np.floor(b.column(1).flatten().to_numpy(zero_copy_only=False) * SCALE)
            if len(scaled) and np.abs(scaled).max() >= 2.0**62:
                raise OverflowError("an entry times 1024 is beyond 64 bits")
            x = (scaled.astype("<i8") + SHIFT).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["vec_id", "x"])

    return store(slim.mapInArrow(convert, f"vec_id {kind}, x binary"), "whole")


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of of(matrix of whole numbers), an array of `size` doubles. Partial sums are added in the order of partitions, so reruns agree to the last bit;
    beyond FAN partitions they are first added up in groups of FAN by tasks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for first in range(0, b.num_rows, CHUNK):
                total += of(_matrix(b.column(0).slice(first, CHUNK)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "s"])

    def group(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t["part"].to_numpy())
        total = np.sum([np.frombuffer(t["s"][int(i)].as_py(), float) for i in order], axis=0)
        return pa.table({"part": [int(key[0].as_py())], "s": pa.array([total.tobytes()], pa.binary())}, pa.schema([("part", pa.int64()), ("s", pa.binary())]))

    sums, parts = rows.select("x").mapInArrow(part, "part long, s binary"), rows.rdd.getNumPartitions()
    while parts > FAN:
        sums, parts = sums.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(group, "part long, s binary"), -(-parts // FAN)
    return np.sum([np.frombuffer(r["s"], float) for r in sorted(sums.collect(), key=lambda r: r["part"])] or [np.zeros(size)], axis=0)


def moments(rows: DataFrame) -> tuple[int, list[int], list[int]]:
    """(n, sums, sums of squares about SHIFT) per dimension, exact: Spark adds up decimals of whole numbers."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0, 0
        for b in batches:
            for first in range(0, b.num_rows, CHUNK):
                y = _matrix(b.column(0).slice(first, CHUNK)) - SHIFT
                n += len(y)
                if not y.size:
                    continue
                if int(np.abs(y).max()) ** 2 * len(y) >= 1 << 62:
                    y = y.astype(object)
                total, square = total + y.sum(axis=0).astype(object), square + (y * y).sum(axis=0).astype(object)
        if n:
            d = len(total) if isinstance(total, np.ndarray) else 0
            out = pa.decimal128(38)
            yield pa.RecordBatch.from_arrays([pa.array([n] * (d + 1)), pa.array(range(-1, d), pa.int32()), pa.array([0, *(total if d else [])], out), pa.array([0, *(square if d else [])], out)], names=["n", "dim", "s", "q"])

    told = rows.select("x").mapInArrow(part, "n long, dim int, s decimal(38,0), q decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    found = sorted((r["dim"], r["n"], int(r["s"]), int(r["q"])) for r in told.collect())  # a row per dimension
    n = found[0][1] if found else 0
    return n, [s for _, _, s, _ in found[1:]], [q for _, _, _, q in found[1:]]


def fit(rows: DataFrame, components: int = COMPONENTS, width: int = WIDTH, degree: int = DEGREE, certified: float = CERTIFIED) -> Whitening:
    """The leading directions of whole()'s rows. The driver holds blocks of dimensions x (components * width) numbers only, whatever the number of rows."""
    n, offsets, squares = moments(rows)
    d = len(offsets)
    sums = [s + n * SHIFT for s in offsets]
    spread = sum(n * q - s * s for s, q in zip(offsets, squares, strict=True))  # n^2 times the trace, exact
    if spread <= 0:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0, np.zeros(0), 1)
    trace, mean, passes = spread / (n * n), np.array(offsets, object), [1]
    whole_mean = (mean // n).astype(np.int64)
    rest_mean = ((mean - whole_mean.astype(object) * n) / n).astype(float)

    def apply(q: np.ndarray) -> np.ndarray:
        """V q, by one pass."""
        passes[0] += 1

        def of(x: np.ndarray) -> np.ndarray:
            centred = (x - SHIFT - whole_mean) - rest_mean
            return (centred.T @ (centred @ q)).ravel()

        return summed(rows, of, q.size).reshape(q.shape) / n

    random = np.random.default_rng(13)
    q = np.linalg.qr(random.standard_normal((d, min(d, components * width))))[0]
    last = math.inf
    for _ in range(ROUNDS):
        vq = apply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        k = min(components, max(1, int((values > RANK * values[0]).sum())))
        residuals = np.linalg.norm(vq - q * values, axis=0)[:k] / values[0]
        worst = float(residuals.max())
        # rounding ends what the residual can lose; one that stalls below a thousand times the aim is at that end
        if worst <= certified or (worst <= 1e3 * certified and worst > last / 4) or len(values) == d:
            sign = np.sign(q[np.abs(q[:, :k]).argmax(axis=0), range(k)])
            return Whitening(n, sums, (q[:, :k] * sign).T, values[:k], trace, residuals, passes[0])
        last, edge = worst, max(float(values[-1]), 1e-3 * float(values[0]))
        centre = half = edge / 2  # the unwanted spectrum lies in [0, edge], if the block holds what lies above
        rate = math.acosh(max(1.0, (values[k - 1] - centre) / half))
        if rate * SLOW < math.log(worst / certified):
            more = min(d, 2 * q.shape[1]) - q.shape[1]
            q = np.linalg.qr(np.hstack([q, random.standard_normal((d, more))]))[0]
            last = math.inf
            continue
        scale = max(1.0, (values[0] - centre) / half)  # recurrence scaled so that the first direction keeps its size
        sigma = 1 / scale
        before, now = q, (vq - centre * q) * (sigma / half)
        tau = sigma
        for _ in range(degree - 1):
            after = 1 / (2 * scale - tau)
            before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (tau * after)
            tau = after
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"directions are {worst:.1e} from certified after {passes[0]} passes")


def _project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - sums as whole numbers, whitened values) of a matrix of rows."""
    sums = np.array(model.sums, object)
    wide = model.n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(sums).max(initial=0)) >= 1 << 62
    away = (x.astype(object) * model.n - sums) if wide else x * model.n - sums.astype(np.int64)
    return away, ((away / model.n).astype(float) @ model.directions.T) / np.sqrt(model.variances)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, by one more pass."""
    k = len(model.variances)

    def of(x: np.ndarray) -> np.ndarray:
        white = _project(x, model)[1]
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    total = summed(rows, of, k + k * k) / model.n
    return float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, white): whole()'s rows with their exact deviation, the sum over dimensions of (n * x - S)^2, and the array of whitened components."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, CHUNK):
                some = b.slice(first, CHUNK)
                away, white = _project(_matrix(some.column(1)), model)
                if away.size and int(np.abs(away).max()) ** 2 * away.shape[1] >= 1 << 63:
                    away = away.astype(object)
                out = [some.column(0), pa.array((away * away).sum(axis=1), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, names=["vec_id", "deviation", "white"])

    return rows.mapInArrow(convert, f"vec_id {kind}, deviation long, white array<double>")


def report(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained (of the trace), identity_error."""
    rows = whole(embeddings, vec_id, embedding)
    model = fit(rows, components)
    error = identity_error(rows, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.variances]).cast("array<double>")
    each = whitened(rows, model).select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
