"""Packing of documents into sequences: cutting stock by column generation over the histogram of lengths.

A document is its text's token ids and an end id. What fills whole sequences is cut off its front; the rest, under one sequence long, is an item. Of all items only a
histogram comes to the driver: how many there are of each length, so `length` numbers at most, whatever the number of documents. Lengths are put into classes, rounded up to at most a 64th or so
(steps of STEP at most); a pattern says how many items of each class one sequence takes. A linear program asks for the fewest sequences: revised simplex on the
classes' rows, started from a greedy basis, each new pattern priced by a knapsack dynamic program on the dual prices, until bounds say that no more than GAP can be gained.
Pattern counts are rounded down, what is left over is filled largest first, and patterns that would waste more than WASTE of a sequence are given up.

Items are ranked over the whole table by (length, id, checksum), so an item's rank within its class says which pattern, copy and place it takes, by arithmetic on
the histogram. Items beyond what patterns take (under a hundredth, unless lengths are such that patterns waste too much) are poured: laid end to end and cut where a sequence is full. So padding is
under WASTE and STEP an item, whatever the lengths, and all other items stay whole.

Null and empty texts are the end id alone; an empty table has no pieces. Repeated rows and equal or null ids are packed row by row. Very long texts are encoded whole
and leave a task piece by piece. Columns other than the id and the text are not looked at. Encoded documents are written to the shared folder once, and everything after that is reckoned from
that table, so a lost executor moves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspan.llm.tokens import VOCABULARY, Encoder
from tallyspan.plans.ranks import ranked
from tallyspan.plans.scratch import store

LENGTH, END = 2048, 1
#: Lengths up to FINE are told apart by the linear program, up to twice that in steps of 2, and so on to steps of STEP; WASTE is the share of a sequence that a pattern may leave, GAP the relative gap at which the program ends.
FINE, STEP, WASTE, GAP = 64, 4, 0.01, 1e-4
#: Documents whose pieces leave a task together.
SLICE = 64


@dataclass
class Plan:
    """classes: the class of each length below `length`; rows: patterns x classes, items of a class in a pattern; copies: sequences of each pattern; bound: the program's lower bound on sequences."""

    length: int
    classes: np.ndarray
    rows: np.ndarray
    copies: np.ndarray
    bound: float
    columns: int


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within the capacity: its value, and how many there are of each. sizes: rising."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = fits[room]
        if k:
            values = prices[:k] + best[room - sizes[:k]]
            at = values.argmax()
            if values[at] > best[room] + 1e-12:
                best[room], took[room] = values[at], at
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= sizes[took[room]]
    return float(best[capacity]), counts


def greedy(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis to start from, and its x: each pattern is filled largest first from classes that are not used up, and taken until one of them is. So every pattern uses up a class of its own, and later
    ones do without that class: the basis is triangular."""
    m = len(sizes)
    left, alive, basis, x = demand.copy(), np.ones(m, bool), np.zeros((m, m)), np.zeros(m)
    for _ in range(m):
        live, room = np.flatnonzero(alive), capacity
        counts, k = np.zeros(m), live[-1]
        while room >= sizes[live[0]]:
            counts[k] += 1
            room -= sizes[k]
            k = live[max(0, np.searchsorted(sizes[live], room, side="right") - 1)]
        on = np.flatnonzero(counts)
        end = on[(left[on] / counts[on]).argmin()]
        x[end] = left[end] / counts[end]
        left = np.maximum(left - x[end] * counts, 0.0)
        alive[end], basis[:, end] = False, counts
    return basis, x


def relaxed(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The linear program min sum(x) with patterns' items = demand: (patterns, x, lower bound, patterns priced in).

    Ends once no pattern prices in, or x is within `gap`, or half a sequence, of the bound: the better of the dual bound and of what the items' sizes need anyway.
    """
    basis, x = greedy(demand, sizes, capacity)
    asked = demand
    demand = demand * (1 + 1e-6 * np.random.default_rng(12).random(len(sizes)))  # no two rows leave at once, so no step is empty
    inverse = np.linalg.inv(basis) if len(sizes) else basis
    x, bound, priced = np.maximum(inverse @ demand, 0.0), float(demand @ sizes) / capacity, 0
    while (total := float(x.sum())) - bound > max(gap * total, 0.5):
        prices = inverse.sum(axis=0)
        value, column = knapsack(np.maximum(prices, 0.0), sizes, capacity)
        bound = max(bound, total / value)
        if value <= 1 + 1e-9:
            break
        along = inverse @ column
        up = np.flatnonzero(along > 1e-9)
        leave = up[(x[up] / along[up]).argmin()]
        step = float(x[leave] / along[leave])
        x = np.maximum(x - step * along, 0.0)
        x[leave], basis[:, leave] = step, column
        row = inverse[leave] / along[leave]
        inverse -= np.outer(along, row)
        inverse[leave] = row
        priced += 1
        if priced % 500 == 0:  # rounding adds up in the updated inverse
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0.0)
    return basis.T.astype(np.int64), np.maximum(inverse @ asked, 0.0), bound, priced


def _filled(left: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern that takes the largest of what is left, then the largest that still fits, and so on."""
    counts, room = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = min(left[k], room // sizes[k])
        room -= counts[k] * sizes[k]
    return counts


def rounded(length: int) -> np.ndarray:
    """What each length below `length` counts as: itself up to FINE, then the next multiple of 2, and so on to multiples of STEP."""
    n, step = np.arange(length), np.ones(length, np.int64)
    while step.max() < STEP and (wide := n > FINE * step.max()).any():
        step[wide] *= 2
    return -(-n // step) * step


def plan(histogram: np.ndarray, length: int = LENGTH, waste: float = WASTE, gap: float = GAP) -> Plan:
    """Patterns and their copies for histogram[n] items of n ids, n < length. No pattern asks for more items than there are."""
    widths, classes = np.unique(rounded(length), return_inverse=True)
    every = np.bincount(classes, histogram).astype(np.int64)
    some = np.flatnonzero(every)
    sizes, demand = widths[some], every[some]
    rows, x, bound, priced = relaxed(demand.astype(float), sizes, length, gap)
    copies = np.floor(x + 1e-9).astype(np.int64)
    least = length * (1 - waste)
    copies[rows @ sizes < least] = 0
    for k in np.flatnonzero(copies @ rows > demand):  # more places than items: give copies up
        for p in np.flatnonzero(rows[:, k] * copies)[::-1]:
            over = int((copies @ rows)[k] - demand[k])
            if over <= 0:
                break
            copies[p] -= min(copies[p], -(-over // rows[p, k]))
    left, more = demand - copies @ rows, []
    while left.any():
        counts = _filled(left, sizes, length)
        if counts @ sizes < least:
            left = left.copy()
            left[np.flatnonzero(left)[-1]] = 0  # what its largest cannot fill up is poured
            continue
        times = int((left[counts > 0] // counts[counts > 0]).min())
        more.append((counts, times))
        left = left - times * counts
    used = copies > 0
    wide = np.zeros((int(used.sum()) + len(more), len(widths)), np.int64)
    wide[: used.sum(), some] = rows[used]
    for k, (counts, _) in enumerate(more):
        wide[used.sum() + k, some] = counts
    return Plan(length, classes, wide, np.array([*copies[used], *(t for _, t in more)], np.int64), bound, priced)


class Places:
    """Where each item goes, by its rank among all items in rising order of length. Small tables only: one entry a length, class or pattern."""

    def __init__(self, histogram: np.ndarray, found: Plan):
        self.plan, n = found, len(histogram)
        self.first = np.concatenate([[0], histogram.cumsum()])  # rank of the first item of each length
        of = found.classes
        self.base = self.first[np.searchsorted(of, np.arange(found.rows.shape[1]))]  # rank of each class's first item
        self.upto = np.vstack([np.zeros(found.rows.shape[1], np.int64), (found.rows * found.copies[:, None]).cumsum(axis=0)])  # places of a class in the patterns before
        self.start = np.concatenate([[0], found.copies.cumsum()])  # first sequence of each pattern
        self.whole = int(self.start[-1])
        low = np.maximum(self.first[:-1], (self.base + self.upto[-1])[of])  # rank of the first poured item of each length
        self.low, poured = low, np.maximum(self.first[1:] - low, 0)
        self.pour = np.concatenate([[0], (poured * np.arange(n)).cumsum()])
        self.sequences = self.whole + -(-int(self.pour[-1]) // found.length)

    def of(self, rank: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, -1 for a poured item; position of a poured item in what is poured)."""
        which = self.plan.classes[size]
        inside = rank - self.base[which]
        sequence = np.full(len(rank), -1, np.int64)
        for c in np.unique(which):
            rows = np.flatnonzero((which == c) & (inside < self.upto[-1, c]))
            p = np.searchsorted(self.upto[:, c], inside[rows], side="right") - 1
            sequence[rows] = self.start[p] + (inside[rows] - self.upto[p, c]) // np.maximum(self.plan.rows[p, c], 1)
        return sequence, np.where(sequence < 0, self.pour[size] + (rank - self.low[size]) * size, -1)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH) -> DataFrame:
    """(part, number, doc_id, n, full_before, crc, ids): a row per document, ids as little-endian numbers of the vocabulary's width with the end id, full_before the whole
    sequences of earlier documents of its part. The vocabulary is read on the driver."""
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number, full = Encoder(ranks.value, end), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                ids = [(coder.encode(t) if t else b"") + coder.end for t in some.column(1).to_pylist()]
                sizes = np.array([len(i) // coder.width for i in ids], np.int64)
                before = full + np.concatenate([[0], (sizes // length).cumsum()])
                numbers, number, full = np.arange(number, number + len(ids)), number + len(ids), int(before[-1])
                columns = [pa.array(np.full(len(ids), part)), pa.array(numbers), some.column(0), pa.array(sizes), pa.array(before[:-1]), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "doc_id", "n", "full_before", "crc", "ids"])

    return slim.mapInArrow(code, f"part long, number long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, full_before long, crc long, ids binary")


def _placed(items: DataFrame, places: Places) -> DataFrame:
    """(part, number, cuts): where an item's one or two pieces go: array of (start in the item, length, sequence, offset)."""
    length = places.plan.length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, pour = places.of(b.column(3).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(pour)], names=["part", "number", "size", "rank", "sequence", "pour"])

    found = items.select("part", "number", "size", "rank").mapInArrow(assign, "part long, number long, size long, rank long, sequence long, pour long")
    before = F.coalesce(F.sum("size").over(W.partitionBy("sequence").orderBy(F.desc("size"), "rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a sequence has `length` items at most

    def piece(start, size, sequence, offset):
        return F.struct(start.alias("start"), size.alias("length"), sequence.alias("sequence"), offset.alias("offset"))

    zero = F.lit(0).cast("long")
    in_pattern = found.where("sequence >= 0").select("part", "number", F.array(piece(zero, F.col("size"), F.col("sequence"), before)).alias("cuts"))
    row, at = F.floor(F.col("pour") / length) + places.whole, F.col("pour") % length
    head = F.least(F.col("size"), length - at)
    cuts = F.array(piece(zero, head, row, at), piece(head, F.col("size") - head, row + 1, zero))
    poured = found.where("sequence < 0").select("part", "number", F.filter(cuts, lambda c: c["length"] > 0).alias("cuts"))
    return in_pattern.unionByName(poured)


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32 (of its ids as little-endian 32-bit numbers), doc_tokens, sequence_id, offset, and its ids as such bytes.

    Sequences are numbered from 0 without gaps: those of patterns, poured ones, then the whole ones cut off long documents.
    """
    if length < 1:
        raise ValueError("length must be positive")
    rows = store(encoded(docs, doc_id, text, vocabulary, end, length), "encoded")
    size = (F.col("n") % length).alias("size")
    histogram = np.zeros(length, np.int64)
    for r in rows.groupBy(size).count().where("size > 0").collect():  # a row per length
        histogram[r["size"]] = r["count"]
    places = Places(histogram, plan(histogram, length))
    full, before = places.sequences, {}
    for r in sorted(rows.groupBy("part").agg(F.max(F.col("full_before") + F.floor(F.col("n") / length)).alias("full")).collect()):  # a row per part
        before[r["part"]], full = full, full + r["full"]
    items = rows.select("part", "number", "doc_id", "crc", size).where("size > 0")
    items = ranked(items, [F.col("size"), F.col("doc_id"), F.col("crc"), F.col("part"), F.col("number")], "rank", 0)
    met = rows.drop("crc").join(_placed(items, places), ["part", "number"], "left").select("part", "number", "doc_id", "n", "full_before", "ids", "cuts")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                which, out = [], []
                for k, (part, n, earlier, ids, cuts) in enumerate(zip(*(some.column(c).to_pylist() for c in (0, 3, 4, 5, 6)), strict=True)):
                    ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                    whole = n // length
                    pieces = [(i * length, length, before[part] + earlier + i, 0) for i in range(whole)]
                    pieces += [(whole * length + c["start"], c["length"], c["sequence"], c["offset"]) for c in cuts or ()]
                    for start, many, sequence, offset in pieces:
                        own = ids[4 * start : 4 * (start + many)]
                        which.append(k)
                        out.append((start, many, zlib.crc32(own), n, sequence, offset, own if with_ids else None))
                columns = [pa.array(c, pa.int64()) for c in zip(*[o[:6] for o in out], strict=True)] or [pa.array([], pa.int64())] * 6
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                columns = [some.column(2).take(pa.array(which, pa.int64())), *columns]
                if with_ids:
                    columns, names = [*columns, pa.array([o[6] for o in out], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """packed() without the ids themselves."""
    return packed(docs, doc_id, text, vocabulary, with_ids=False)
