"""Observations in one order, cut into contiguous blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.functions.literals import spelling
from tallyspan.plans.ranks import ranked
from tallyspan.plans.scratch import store


def chain(rows: DataFrame, pilot: Column) -> DataFrame:
    """rows with their rank, from 0, by pilot, chromosome and position, both as text."""
    return ranked(rows.withColumn("pilot", pilot), ["pilot", *names()], "rank", 0)


def names() -> list[Column]:
    """What tells rows of one pilot apart."""
    return [F.col("chrom").cast("string"), spelling(F.col("pos"))]


def places(rows: DataFrame, pilot: Column, sizes: DataFrame, some: DataFrame) -> DataFrame:
    """some (chrom, pos, pilot and any other columns), few rows of the chain that rows make, with their rank in it. sizes: (pilot, n), how many rows have each pilot.

    The chain is not put in order: rows of lesser pilots are counted by their sizes, and those of the same pilot that come first in a pass over rows.
    """
    keys = store(some.select("pilot", *[c.alias(k) for c, k in zip(names(), ("_c", "_p"), strict=True)]).distinct(), "keys")
    lesser = sizes.select(F.col("pilot").alias("_at"), "n").join(F.broadcast(keys), F.col("_at") < F.col("pilot")).select("pilot", "_c", "_p", "n")
    chrom, pos = names()
    before = (chrom < F.col("_c")) | (chrom == F.col("_c")) & (pos < F.col("_p"))
    alike = rows.select(pilot.alias("pilot"), "chrom", "pos").join(F.broadcast(keys), "pilot").where(before).groupBy("pilot", "_c", "_p").agg(F.count("*").alias("n"))
    ranks = lesser.unionByName(alike).unionByName(keys.withColumn("n", F.lit(0).cast("long"))).groupBy("pilot", "_c", "_p").agg(F.sum("n").alias("rank"))
    named = some.select("*", *[c.alias(k) for c, k in zip(names(), ("_c", "_p"), strict=True)])
    return named.join(F.broadcast(ranks), ["pilot", "_c", "_p"]).drop("_c", "_p")


def _edges(ranks: DataFrame, value: str) -> DataFrame:
    """(rank, here, next): each row with its successor. Stretches of ranks are windows; a stretch's last row meets the next stretch's first by a join."""
    stretch = 1 << 16
    rows = ranks.select("rank", F.col(value).alias("here"), F.floor(F.col("rank") / stretch).alias("s"))
    after = F.lead("here").over(W.partitionBy("s").orderBy("rank"))
    first = rows.where(F.col("rank") % stretch == 0).select((F.col("s") - 1).alias("s"), F.col("here").alias("first"))
    return rows.withColumn("after", after).join(first, "s", "left").select("rank", "here", F.when(F.col("rank") % stretch == stretch - 1, F.col("first")).otherwise(F.col("after")).alias("next"))


def jumps(ranks: DataFrame, value: str, k: int) -> DataFrame:
    """The k - 1 largest steps between neighbours, ties to the smaller rank; a step of 0 is none: rank, step, place."""
    steps = _edges(ranks, value).where("next is not null").select("rank", (F.col("next") - F.col("here")).alias("step")).where("step <> 0")
    best = steps.orderBy(F.abs("step").desc(), "rank").limit(max(0, k - 1))
    return best.withColumn("place", F.row_number().over(W.orderBy(F.abs("step").desc(), "rank")).cast("long"))


def labelled(ranks: DataFrame, cuts: list[int]) -> DataFrame:
    """ranks with block, the number of cuts at or before the rank. Cuts are first ranks of blocks, and few."""
    return ranks.withColumn("block", sum((F.when(F.col("rank") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long"))


def block_stats(blocks: DataFrame, value: str) -> DataFrame:
    return blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), (F.max(value) - F.min(value)).alias("spread"), F.avg(value).alias("mean"))


def _prefix_best(v: np.ndarray, low: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For rows scored v (rows x labels) whose labels start at `low` or above and never fall: best[b], the best total with labels up
    to b, and for each label above low what starting its block after so many rows gains."""
    sums = np.vstack([np.zeros(v.shape[1]), v.cumsum(axis=0)])
    best, gains = np.full(v.shape[1], -np.inf), []
    reached = sums[:, low]
    best[low] = reached[-1]
    for b in range(low + 1, v.shape[1]):
        gains.append(reached - sums[:, b])
        reached = np.maximum.accumulate(gains[-1]) + sums[:, b]
        best[b] = reached[-1]
    return best, gains


def best_blocks(ranks: DataFrame, scores: list[Column], weight: Column | None = None) -> tuple[float, list[int]]:
    """(total, cuts) of the ordered assignment that scores most: the row at rank i takes score k_i, and k never falls along the ranks."""
    return best_blocks_each(ranks, F.array(*[s if weight is None else s * weight for s in scores]), [len(scores)])[0]


def best_blocks_each(ranks: DataFrame, values: Column, widths: list[int]) -> list[tuple[float, list[int]]]:
    """best_blocks for several sets of labels in the same passes: values holds their scores one after another, widths how many each set has.

    A block may be empty, which repeats its cut; of equal starts the earliest counts. Scores must be finite. The optimum comes from
    two passes over ranges of ranks, not one scan over all: each range gives the best total for entering at label a and leaving at
    label b, q x q numbers a set, which are chained on the driver; then each range, knowing where it is entered and left,
    gives its blocks' sizes.
    """
    ends = np.cumsum(widths)
    spans = [(int(e - q), int(e)) for e, q in zip(ends, widths, strict=True)]
    parts = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = store(ranks.select("rank", values.alias("v")).repartitionByRange(parts, "rank").withColumn("part", F.spark_partition_id()), "ranges", codec="lz4")

    def matrix(t: pa.Table) -> np.ndarray:
        order = np.argsort(t["rank"].to_numpy(), kind="stable")
        return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, int(ends[-1]))[order]

    def totals(key: tuple, t: pa.Table) -> pa.Table:
        v = matrix(t)
        m = np.concatenate([_prefix_best(v[:, lo:hi], a)[0] for lo, hi in spans for a in range(hi - lo)])
        return pa.table({"part": [key[0].as_py()], "m": [m.tolist()]}, pa.schema([("part", pa.int32()), ("m", pa.list_(pa.float64()))]))

    found = sorted((r["part"], r["m"]) for r in dealt.groupBy("part").applyInArrow(totals, "part int, m array<double>").toLocalIterator())
    squares = np.cumsum([0, *(q * q for q in widths)])
    best, routes = [], {part: [] for part, _ in found}
    for k, q in enumerate(widths):
        state, back = np.array([0.0] + [-np.inf] * (q - 1)), []
        for _, m in found:
            paths = state[:, None] + np.array(m[squares[k] : squares[k + 1]]).reshape(q, q)
            back.append(paths.argmax(axis=0))
            state = paths.max(axis=0)
        end = q - 1
        for (part, _), b in zip(reversed(found), reversed(back), strict=True):
            routes[part].append((int(b[end]), end))
            end = int(b[end])
        best.append(float(state[-1]))

    def sizes(key: tuple, t: pa.Table) -> pa.Table:
        v, n = matrix(t), np.zeros(int(ends[-1]), np.int64)
        for (lo, hi), (low, high) in zip(spans, routes[key[0].as_py()], strict=True):
            gains, upto = _prefix_best(v[:, lo:hi], low)[1], len(v)
            for b in range(high, low, -1):
                at = int(gains[b - low - 1][: upto + 1].argmax())
                n[lo + b], upto = upto - at, at
            n[lo + low] = upto
        return pa.table({"label": pa.array(np.arange(len(n))), "n": pa.array(n)})

    counts = {r["label"]: r["n"] for r in dealt.groupBy("part").applyInArrow(sizes, "label long, n long").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return [(total, np.cumsum([counts.get(k, 0) for k in range(lo, hi - 1)]).astype(int).tolist()) for total, (lo, hi) in zip(best, spans, strict=True)]


#: Rows of a range of ranks that one task scans.
RANGE_ROWS = 1 << 20


def in_ranges(ranks: DataFrame, total: int, rows: int = RANGE_ROWS) -> DataFrame:
    """ranks stored in the order of their ranks: each part of the table is a range of at most about `rows` of them, of fewer as long as there are no more parts than shuffle partitions."""
    parts = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(ranks.repartitionByRange(max(1, -(-total // rows), min(parts, total // 4096)), "rank").sortWithinPartitions("rank"), "ranges", codec="lz4")


def _running(gain: np.ndarray, never: np.ndarray) -> np.ndarray:
    """For each t the place of the largest gain among those before or at t in t's stretch, the first if tied; -1 if all are minus infinity. never: stretch numbers, rising."""
    n = len(gain)
    if never[-1] == never[0]:
        upto = np.maximum.accumulate(gain)
        return np.maximum.accumulate(np.where(gain > np.concatenate([[-np.inf], upto[:-1]]), np.arange(n), -1))
    order = np.lexsort((-np.arange(n), gain))  # of equal gains the first comes last, and so counts as the largest
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    found = order[np.maximum.accumulate(place + never * n) - never * n]
    return np.where(np.isneginf(gain[found]), -1, found)


class _Run:
    """Consecutive rows scanned so far. value[a + 1, b]: the best total over them for labels that go on from label a, or start anew if a = -1, and end with b, each
    row's label being that of the row before or the next one; starts[a + 1][b]: the ranks at which labels began on that way."""

    def __init__(self, q: int, first: bool):
        self.q, self.value = q, np.full((q + 1, q), -np.inf)
        self.starts: list[list[tuple]] = [[() for _ in range(q)] for _ in range(q + 1)]
        self.entries = [0] if first else range(1, q + 1)
        for a in self.entries:
            if a:
                self.value[a, a - 1] = 0.0

    def extend(self, ranks: np.ndarray, v: np.ndarray, first: bool) -> None:
        """v: rows x labels, minus infinity allowed. first: whether nothing was scanned before."""
        n, q = v.shape
        bad = np.isneginf(v)
        sums = np.vstack([np.zeros(q), np.where(bad, 0.0, v).cumsum(axis=0)])
        never = np.vstack([np.zeros(q, np.int64), bad.cumsum(axis=0)])
        for a in self.entries:
            old = self.value[a].copy()
            before = np.full(n + 1, -np.inf)
            if a == 0 and first:
                before[0] = 0.0  # nothing has a label yet
            places, stays, new = [], [], []
            for b in range(q):
                gain = before[:n].copy()
                stays.append(old[b] > -np.inf and old[b] >= gain[0])
                gain[0] = max(gain[0], old[b])
                at = _running(gain - sums[:n, b], never[:n, b])
                good = (at >= 0) & (never[1:, b] == never[:n, b])
                reached = np.full(n + 1, -np.inf)
                reached[0] = old[b]
                reached[1:][good] = (gain[at[good]] - sums[at[good], b]) + sums[1:, b][good]
                places.append(at)
                before = reached
                new.append(reached[n])
            told = []
            for b in range(q):
                way, label, t = [], b, n
                while new[b] > -np.inf:
                    t = int(places[label][t - 1]) if t else 0
                    if t == 0 and stays[label]:
                        told.append((*self.starts[a][label], *reversed(way)))
                        break
                    way.append(int(ranks[t]))
                    label -= 1
                    if label < 0:
                        told.append(tuple(reversed(way)))
                        break
                    if t == 0:
                        told.append((*self.starts[a][label], *reversed(way)))
                        break
                else:
                    told.append(())
            self.value[a], self.starts[a] = new, told


def ordered_scan(chain: DataFrame, columns: list, scores, widths: list[int]) -> list[tuple[float, list[int]]]:
    """See ordered_partitions. chain: as in_ranges() stores it, or its rows in any other order, which only makes for more and shorter runs. scores: a batch with `columns` -> rows x all labels."""
    ends = np.cumsum(widths)
    spans = [(int(e - q), int(e)) for e, q in zip(ends, widths, strict=True)]

    def scan(batches):
        runs, opened, upto = None, None, None

        def told():
            value = [float(x) for r in runs for x in r.value.ravel()]
            starts = [[-1] * (r.q - len(s)) + list(s) for r in runs for row in r.starts for s in row]
            return pa.RecordBatch.from_arrays([pa.array([opened]), pa.array([upto]), pa.array([value], pa.list_(pa.float64())), pa.array([[s for each in starts for s in each]], pa.list_(pa.int64()))], names=["first", "last", "value", "starts"])

        for b in batches:
            ranks = b.column(0).to_numpy()
            breaks = [0, *(np.flatnonzero(np.diff(ranks) != 1) + 1), len(ranks)] if len(ranks) else []
            for lo, hi in zip(breaks, breaks[1:], strict=False):
                v = scores(b.slice(lo, hi - lo))
                fresh = runs is None or ranks[lo] != upto + 1
                if fresh:
                    if runs is not None:
                        yield told()
                    runs, opened = [_Run(q, ranks[lo] == 0) for q in widths], int(ranks[lo])
                for (s, e), run in zip(spans, runs, strict=True):
                    run.extend(ranks[lo:hi], v[:, s:e], fresh)
                upto = int(ranks[hi - 1])
        if runs is not None:
            yield told()

    found = chain.select("rank", *columns).mapInArrow(scan, "first long, last long, value array<double>, starts array<long>").orderBy("first")
    state, expected = [None] * len(widths), 0
    for r in found.toLocalIterator():  # one row per run, a few numbers each; they are chained one after another
        if r["first"] != expected:
            raise ValueError("ranks must be 0, 1, 2, ... without gaps")
        expected, i, j = r["last"] + 1, 0, 0
        for k, q in enumerate(widths):
            value = np.array(r["value"][i : i + (q + 1) * q]).reshape(q + 1, q)
            starts = np.array(r["starts"][j : j + (q + 1) * q * q]).reshape(q + 1, q, q)
            i, j = i + value.size, j + starts.size
            own = lambda a, b, starts=starts: tuple(int(s) for s in starts[a, b] if s >= 0)
            if state[k] is None:
                state[k] = [(float(value[0, b]), own(0, b)) for b in range(q)]
                continue
            new = []
            for b in range(q):
                paths = [state[k][a][0] + value[a + 1, b] for a in range(q)]
                a = max(range(q), key=lambda a: (paths[a], a))  # of equal ones the one that got furthest, whose cuts are earlier
                new.append((float(paths[a]), (*state[k][a][1], *own(a + 1, b))) if paths[a] > -np.inf else (-np.inf, ()))
            state[k] = new
    out = []
    for q, s in zip(widths, state, strict=True):
        if s is None or s[q - 1][0] == -np.inf:
            raise ValueError(f"no partition into {q} blocks with a row each has a finite total")
        out.append((s[q - 1][0], list(s[q - 1][1][1:])))  # the first start is rank 0
    return out


def ordered_partitions(ranks: DataFrame, values: Column, widths: list[int]) -> list[tuple[float, list[int]]]:
    """(total, cuts) of the best partition of ranks 0, 1, ... into as many blocks, in order and none empty, as each set has labels: block b's rows take score b.

    values: an array of scores, set after set; minus infinity means that the row cannot be in that block. Of equal totals the one with the earlier cuts, last cut first, counts. One pass over
    ranges of ranks, each of about RANGE_ROWS rows read in batches; a range tells for each label it may be entered with and left with the best total and the cuts, and ranges are chained on the driver.
    ValueError if no partition has a finite total, as when there are fewer rows than labels.
    """
    given = ranks.select("rank", values.alias("v"))
    total = given.count()

    def matrix(b):
        return b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    return ordered_scan(in_ranges(given, total), ["v"], matrix, widths)
