"""Hard negatives by angular triangle filtering: exact integer scores, computed only where bounds from stored angles leave a row in question.

Components become integers, floor(256 * x). For every row its norm and its angles to a few reference directions are stored. Two vectors at angles p and q to one
reference are between |p - q| and min(p + q, 2 pi - p - q) apart, so all references together give an interval of the cosine; times both norms, and widened by more than
rounding can do, it bounds the integer score. Rows lie sorted by their nearest reference, so whole blocks of rows are bounded first, then rows; only pairs
whose interval meets the window that an anchor still has open are scored.

Anchors go in blocks of ANCHORS through all rows, two passes a block: the first finds each anchor's positives, its best rows of the same label, and the window is what is not below the
worst of those found so far; then each positive opens a window of scores for rows of other labels. A task keeps the best few of each window, and Spark merges those of all
tasks; no row's partners are capped on the way, as what a task drops is beaten by what it keeps.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors of another length than the most frequent one (ties: the longest). Where the
id is divisible by RELABEL, the label first becomes (label + 1) % CLASSES. A null id is no anchor, comes last among equal scores, and its label stays. Repeated rows count as often as they occur; an anchor's other
rows are those of another id. Zero vectors score 0. An empty table, or one without anchors, gives no rows. Integers beyond 32 bits and scores beyond 64 raise an error. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.plans.ranks import ranked
from tallyspan.plans.scratch import new_path, store

SCALE = 256.0
EVERY, RELABEL, CLASSES = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Reference directions, the rows that they are chosen from (by a hash), anchors that are broadcast together, rows of a block.
REFERENCES, SAMPLE, ANCHORS, BLOCK = 12, 512, 4096, 512
#: Angles and scores (relative to the norms) are widened by more than single precision can be wrong.
ANGLE_SLACK, SCORE_SLACK = 1e-5, 1e-6
#: Stands for a null id, which comes last.
NO_ID = np.iinfo(np.int64).max
NOTHING = np.iinfo(np.int64).min
#: Above this share of pairs in question a block is scored as one matrix product.
DENSE = 0.1


def whole(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, x): the rows that take part, relabelled, x their integers as little-endian 32-bit binaries."""
    entries = F.col(f"`{embedding}`").cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    slim = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), entries.alias("c")).where(F.col("c").isNotNull() & F.col("label").isNotNull() & good)
    found = slim.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    slim = slim.where(F.size("c") == (found["d"] if found else 0))
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).alias("label")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(b.column(2).flatten().to_numpy(zero_copy_only=False) * SCALE)
            if np.abs(x).max(initial=0) >= 2.0**31:
                raise OverflowError("a component times 256 is beyond 32 bits")
            x = x.astype("<i4").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["vec_id", "label", "x"])

    return slim.select("vec_id", moved, "c").mapInArrow(convert, "vec_id long, label long, x binary")


def _integers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1).astype(float)


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def references(rows: DataFrame, count: int = REFERENCES, sample: int = SAMPLE) -> np.ndarray:
    """Directions far from each other: of a bounded sample its mean's, then always the row's that is farthest from all before. They only tell how tight bounds are."""
    some = rows.orderBy(F.xxhash64("x", "vec_id"), "x").limit(sample).select("x").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    units = _units(_integers(some["x"].combine_chunks()))
    found = [*_units(units.mean(axis=0, keepdims=True))]
    nearest = units @ found[0]
    while len(found) < min(count, len(units)) and nearest.min() < 1 - 1e-6:
        found.append(units[nearest.argmin()])
        nearest = np.maximum(nearest, units @ found[-1])
    return np.array(found)


def _angles(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(x) @ refs.T, -1.0, 1.0)).astype("<f4")


def prepared(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """whole()'s rows with norm and angles (32-bit binaries), written to the shared folder, within each partition by nearest reference and angle to it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column(2))
            angles = _angles(x, refs)
            near = angles.argmin(axis=1) if angles.size else np.zeros(len(x), np.int64)
            closest = angles.min(axis=1) if angles.size else np.zeros(len(x), np.float32)
            columns = [*b.columns, pa.array(np.linalg.norm(x, axis=1)), pa.array([row.tobytes() for row in angles], pa.binary()), pa.array(near, pa.int32()), pa.array(closest, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "norm", "angles", "near", "closest"])

    full = rows.mapInArrow(measure, "vec_id long, label long, x binary, norm double, angles binary, near int, closest float")
    return store(full.sortWithinPartitions("near", "closest"), "measured")


class Anchors:
    """A block of anchors: ids, labels, norms, integers and angles. parts() is what is broadcast: plain arrays, which executors read without this package."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, norm: np.ndarray, x: np.ndarray, angles: np.ndarray):
        self.ids, self.labels, self.norm, self.x, self.angles = ids, labels, norm, x, angles

    @classmethod
    def of(cls, t: pa.Table) -> Anchors:
        t = t.combine_chunks()
        angles = np.frombuffer(b"".join(t["angles"].to_pylist()), "<f4").reshape(t.num_rows, -1)
        return cls(*(t[c].to_numpy() for c in ("vec_id", "label", "norm")), _integers(t["x"].combine_chunks()), angles)

    def parts(self) -> tuple:
        return self.ids, self.labels, self.norm, self.x, self.angles


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows with whole-number rows: in doubles where no sum can pass 2^53."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 2.0**53:
        return (x @ y.T).astype(np.int64)
    if bound >= 2.0**62:
        raise OverflowError("a score may be beyond 64 bits")
    return x.astype(np.int64) @ y.astype(np.int64).T


def interval(rows: np.ndarray, norms: np.ndarray, anchors: np.ndarray, anchor_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x anchors: bounds on scores from angles to the same references (rows x references, anchors x references)."""
    least, most = np.zeros((len(rows), len(anchors)), np.float32), np.full((len(rows), len(anchors)), np.float32(math.pi))
    for k in range(rows.shape[1]):
        p, q = rows[:, k, None], anchors[None, :, k]
        np.maximum(least, np.abs(p - q), out=least)
        both = p + q
        np.minimum(most, np.minimum(both, np.float32(2 * math.pi) - both), out=most)
    size = norms[:, None] * anchor_norms
    high = np.cos(np.maximum(least - np.float32(ANGLE_SLACK), 0.0)) + np.float32(SCORE_SLACK)
    low = np.cos(np.minimum(most + np.float32(ANGLE_SLACK), np.float32(math.pi))) - np.float32(SCORE_SLACK)
    return low * size, high * size


def block_interval(rows: np.ndarray, norms: np.ndarray, anchors: np.ndarray, anchor_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on the scores of all rows of a block with each anchor."""
    first, last = rows.min(axis=0, initial=math.pi), rows.max(axis=0, initial=0)
    least = np.maximum(np.maximum(anchors - last, first - anchors), 0).max(axis=1, initial=0)
    most = np.minimum(anchors + last, 2 * math.pi - anchors - first).min(axis=1, initial=math.pi)
    high = np.cos(np.maximum(least - ANGLE_SLACK, 0.0)) + SCORE_SLACK
    low = np.cos(np.minimum(most + ANGLE_SLACK, math.pi)) - SCORE_SLACK
    small, large = norms.min() * anchor_norms, norms.max() * anchor_norms
    return np.minimum(low * small, low * large), np.maximum(high * small, high * large)


class Best:
    """The best few (score, id) of each of n lists, by falling score, then rising id."""

    def __init__(self, n: int, keep: int):
        self.score, self.id = np.full((n, keep), NOTHING), np.full((n, keep), NO_ID)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, lists: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
        """found: rows x lists, NOTHING where a row is no candidate; ids rising."""
        some = np.flatnonzero((found >= np.maximum(self.worst()[lists], NOTHING + 1)).any(axis=0))
        if not len(some):
            return
        lists, found, keep = lists[some], found[:, some], self.score.shape[1]
        top, best = self._top(found, keep)
        score, own = np.hstack([self.score[lists], best]), np.hstack([self.id[lists], np.where(best == NOTHING, NO_ID, ids[top])])
        order = np.lexsort((own, -np.maximum(score, NOTHING + 1)), axis=1)[:, :keep]
        self.score[lists], self.id[lists] = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)

    @staticmethod
    def _top(found: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values) of the best `keep` of each column, a line each; of equal ones the first. Where a column has fewer candidates, the rest are NOTHING."""
        left, columns = found.copy(), np.arange(found.shape[1])
        rows, values = np.empty((2, len(columns), keep), np.int64)
        for k in range(keep):
            rows[:, k] = at = left.argmax(axis=0)
            values[:, k] = left[at, columns]
            left[at, columns] = NOTHING
        return rows, values


def _scan(batches: Iterator[pa.RecordBatch], anchors: Anchors, same: bool, windows: np.ndarray, best: Best) -> np.ndarray:
    """Offers to best what lies in the windows: anchors x slots x (low, high), a list for each anchor and slot. Returns pairs, pairs bounded one by one, pairs scored."""
    slots, told = windows.shape[1], np.zeros(3, np.int64)
    lists = np.arange(len(anchors.ids) * slots).reshape(-1, slots)
    low, high = windows[:, :, 0], windows[:, :, 1]
    open_ = low <= high
    for b in batches:
        for first in range(0, b.num_rows, BLOCK):
            some = b.slice(first, BLOCK)
            ids = np.array([NO_ID if i is None else i for i in some.column(0).to_pylist()], np.int64)
            order = np.argsort(ids, kind="stable")
            ids, labels, norms = ids[order], some.column(1).to_numpy()[order], some.column(3).to_numpy()[order]
            angles = np.frombuffer(b"".join(some.column(4).to_pylist()), "<f4").reshape(len(ids), -1)[order]
            # what a list still takes: not under its worst
            floor = np.where(open_, np.maximum(low, best.worst().reshape(-1, slots)), NO_ID).min(axis=1).astype(float)
            ceiling = np.where(open_, high, NOTHING).max(axis=1).astype(float)
            down, up = block_interval(angles, norms, anchors.angles, anchors.norm)
            at = np.flatnonzero((up >= floor) & (down <= ceiling))
            told += [len(ids) * len(anchors.ids), len(ids) * len(at), 0]
            if not len(at):
                continue
            down, up = interval(angles, norms, anchors.angles[at], anchors.norm[at])
            asked = (up >= floor[at]) & (down <= ceiling[at]) & ((labels[:, None] == anchors.labels[at]) == same) & (ids[:, None] != anchors.ids[at])
            cols = np.flatnonzero(asked.any(axis=0))
            if not len(cols):
                continue
            asked, at = asked[:, cols], at[cols]
            x = _integers(some.column(2))[order]
            if asked.mean() > DENSE:
                found = np.where(asked, scores(x, anchors.x[at]), NOTHING)
                told[2] += found.size
            else:
                i, j = np.nonzero(asked)
                told[2] += len(i)
                found = np.full(asked.shape, NOTHING)
                for k in range(0, len(i), 1 << 15):  # pairs are scored one by one
                    p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                    found[p, q] = _pairwise(x[p], anchors.x[at[q]])
            for s in range(slots):
                on = np.flatnonzero(open_[at, s])
                here = found[:, on]
                best.offer(lists[at[on], s], np.where((here >= low[at[on], s]) & (here <= high[at[on], s]), here, NOTHING), ids)
    return told


def _pairwise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 2.0**53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    if bound >= 2.0**62:
        raise OverflowError("a score may be beyond 64 bits")
    return np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))


def _search(rows: DataFrame, block, same: bool, windows: np.ndarray, keep: int) -> DataFrame:
    """(anchor, slot, id, score, place): the best `keep` rows of every window of the broadcast block of anchors, from one pass over the rows."""
    slots = windows.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*block.value)
        best = Best(len(anchors.ids) * slots, keep)
        _scan(batches, anchors, same, windows, best)
        which, place = np.nonzero(best.score != NOTHING)
        ids, found = best.id[which, place], best.score[which, place]
        yield pa.RecordBatch.from_arrays([pa.array(which // slots, pa.int32()), pa.array(which % slots, pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(found)], names=["anchor", "slot", "id", "score"])

    found = rows.select("vec_id", "label", "x", "norm", "angles").mapInArrow(part, "anchor int, slot int, id long, score long")
    place = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id")))  # `keep` rows a task at most
    return found.withColumn("place", place).where(F.col("place") <= keep)


def mined(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row whose id is divisible by `every`, and each of its positives the best
    rows of other labels whose score is from `low` to `high` hundredths of the positive's. anchors: how many go through the rows together."""
    rows = whole(embeddings, vec_id, embedding, label)
    rows = prepared(rows, references(rows))
    numbered = store(ranked(rows.where(F.col("vec_id") % every == 0).drop("near", "closest"), [F.col("vec_id"), F.col("label"), F.col("x")], "number", 0), "anchors")
    total, base = numbered.count(), new_path(rows.sparkSession, "negatives")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for k in range(0, total, anchors):
        block = Anchors.of(numbered.where((F.col("number") >= k) & (F.col("number") < k + anchors)).orderBy("number").toArrow())  # at most `anchors` rows
        shared = rows.sparkSession.sparkContext.broadcast(block.parts())
        everything = np.tile(np.array([NOTHING + 1, NO_ID - 1]), (len(block.ids), 1, 1))
        best = store(_search(rows, shared, True, everything, positives), "positives")
        known = np.full((len(block.ids), positives, 2), [[1, 0]], np.int64)  # closed
        for r in best.toLocalIterator():  # `positives` rows an anchor
            known[r["anchor"], r["place"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        near = best.select("anchor", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        far = _search(rows, shared, False, known, negatives).select("anchor", "slot", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        names = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"anchor": pa.array(range(len(block.ids)), pa.int32()), "anchor_id": pa.array(block.ids)})))  # at most `anchors` rows
        out = far.join(near, ["anchor", "slot"]).join(names, "anchor")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{base}/block={k // anchors}")
        shared.unpersist()
    if not total:
        return rows.sparkSession.createDataFrame([], shape)
    return rows.sparkSession.read.schema(shape).parquet(*[f"{base}/block={k}" for k in range(-(-total // anchors))])


#: The same rows by plain SQL, all anchors against all rows.
ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label, row_number() OVER () AS k,
         list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), a AS (SELECT * FROM v WHERE vec_id % {EVERY} = 0),
s AS (
  SELECT a.k AS a_k, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score
  FROM a JOIN v ON v.vec_id IS DISTINCT FROM a.vec_id
), p AS (
  SELECT a_k, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a_k ORDER BY score DESC, vec_id NULLS LAST) AS place
  FROM s WHERE same QUALIFY place <= {POSITIVES}
), n AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.a_k, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a_k = p.a_k AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""
