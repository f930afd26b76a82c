"""Substring deduplication over a log-structured index of window hashes.

A window is WIDTH consecutive words of a document. Each batch of documents is hashed, dealt by hash, merged with the sorted,
immutable runs of earlier batches, verified, and written as a run of its own; runs are compacted into one once
there are FANOUT of them. All runs are bucketed by the same hash into the same number of buckets, so a batch meets
its history bucket by bucket: only the batch is shuffled. A word is removed if a window over it also starts in a document with a
smaller id; windows are judged on the input.

What is hashed and sorted are stretches: consecutive windows that have the same anchor, the smallest hash of ANCHOR words within a
window, the leftmost if tied. Equal windows have equal anchors, so all places of a window meet under its
anchor. A stretch that stands whole in a smaller document is settled at once (128 bits of hash: anchor and
stretch). Of anchors that have different stretches, the first document of each is verified window by window, on
hashes of 128 bits taken from the texts, the historical ones included. That leaves a few rows for each hundred words to
shuffle, instead of one a window. The index keeps the texts, bucketed by their ids: they are shuffled once, when they come in.

Copies are settled before the shuffle where a task sees them together, and then spread by an unrelated key.

Null and empty texts have no words, an empty table gives none. A null id counts as larger than all others; ids that are no whole numbers are
refused. Rows with one id are one document, told apart by their texts: neither is removed for the other's sake, and repeated rows give
repeated results. Texts of up to 2**31 words are taken whole. Extra columns are not looked at.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.llm.hashing import NOT_SPACE, mixed, places_within, rolled, spans, word_hashes
from tallyspan.plans.scratch import new_path, remove

WIDTH = 13
ANCHOR = 6
FANOUT = 2
#: Rows that a task settles among themselves before it hands them on.
TOGETHER = 1 << 20
#: Bytes of texts that are hashed at once, about; a longer text is taken by itself.
CHUNK = 1 << 17
LAST = (1 << 63) - 1
#: Where deduplicated() ends its batches: each is history for the next, and there is one more of them than FANOUT, so runs are compacted.
SHARES = (0.25, 0.5)

_ROW = "a long, s long, d long, at long"
_PLACE = 31  # bits of a window's place in its text


def count_bits(width: int, anchor: int = ANCHOR) -> int:
    """Bits of at, a row's place, that hold its number of windows; the window's place stands above them, and what is left holds the text's hash."""
    bits = (width - anchor + 1).bit_length()
    if not anchor <= width or bits > 12:
        raise ValueError(f"windows of {width} words: at least {anchor} and under {anchor + (1 << 12) - 1} are taken")
    return bits


def anchored(h: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of the stretches of word hashes. text: the number of each word's text, if of several; no window goes over its end."""
    n = len(h) - width + 1
    window = np.arange(max(n, 0)) if text is None or n <= 0 else np.flatnonzero(text[:n] == text[width - 1 :])
    if not len(window):
        return np.zeros(0, np.uint64), window, window
    grams = rolled(h, anchor)
    best, at, wide = grams, np.arange(len(grams)), 1
    while wide <= width - anchor:  # the leftmost least of `wide` grams in a row; blocks may overlap
        step = min(wide, width - anchor + 1 - wide)
        less = best[step:] < best[:-step]
        best, at, wide = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step]), wide + step
    at = at[window]
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # windows of different texts have no gram in common
    return grams[at[edge]], window[edge], np.diff(np.append(edge, len(at)))


def stretches(h: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, stretch hash, first window, number of windows), as anchored(). A stretch has at most width - anchor + 1 windows."""
    a, first, count = anchored(h, width, anchor, text)
    if not len(a):
        return a, a, first, count
    return a, mixed(spans(h, first, first + count + width - 1), 0x5851F42D4C957F2D) + count.astype(np.uint64), first, count


def window_hashes(h: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that begins at one of the words `start`, from its first word on and from its last word back."""
    there, back = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(width):
        there = there * np.uint64(0x9E3779B97F4A7C15) + h[start + k]
        back = back * np.uint64(0x9E3779B97F4A7C15) + h[start + (width - 1 - k)]
    return mixed(there), mixed(back, 1)


def _settled(a: np.ndarray, s: np.ndarray, d: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows as they are handed on. One whose (a, s) also has a smaller d among them is settled: at becomes -at - 1, a and s something unrelated."""
    order = np.argsort(a)
    again = np.diff(a[order]) == 0
    some = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]  # whose a others have too
    if len(some):
        some = some[np.lexsort((d[some], s[some], a[some]))]
        x, y, z = a[some], s[some], d[some]
        edge = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        done = some[z > z[np.maximum.accumulate(np.where(edge, np.arange(len(some)), 0))]]
        a[done], s[done] = mixed(at[done].astype(np.uint64) * np.uint64(31) + d[done].astype(np.uint64)).view(np.int64), 0
        at[done] = -at[done] - 1
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, s, d, at)], names=["a", "s", "d", "at"])


def _rows(make, bits: int):
    """Runs over (d, t, text, ...): make(words' hashes, the number of each word's row, batch) gives a, s, first word, count of each row to hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raws = batch.column(2).fill_null(b"").cast(pa.large_binary())
            ends, data = np.frombuffer(raws.buffers()[1], np.int64)[raws.offset :][: len(raws) + 1], np.frombuffer(raws.buffers()[2] or b"", np.uint8)
            low = 0
            while low < len(raws):  # texts low to high are hashed end to end
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK, "right")) - 1)
                raw, bounds = data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
                places = places_within(raw, bounds, NOT_SPACE)
                begin = np.searchsorted(places[0], bounds)
                row = np.repeat(np.arange(low, high), np.diff(begin))
                a, s, first, count = make(word_hashes(raw, *places), row, batch)
                if len(a):
                    of = row[first]
                    at = (t[of] << _PLACE + bits) + (first - begin[of - low] << bits) + count
                    parts.append((a.view(np.int64), s.view(np.int64), d[of], at))
                    n += len(a)
                if n >= TOGETHER:
                    yield _settled(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, n = [], 0
                low = high
        if parts:
            yield _settled(*map(np.concatenate, zip(*parts, strict=True)))

    return run


class SubstringIndex:
    """The runs under `path`, a folder that driver and executors share. Batches must come in the order of their ids."""

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, fanout: int = FANOUT):
        self.spark, self.path, self.width, self.fanout = spark, path or new_path(spark, "substring-index"), width, fanout
        self.bits, self.buckets = count_bits(width), int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.merged: list[str] = []
        self.tables: list[str] = []

    def _table(self, df: DataFrame, by: str, order: tuple[str, ...]) -> str:
        """df, dealt by `by`, as a bucketed and sorted table under the index's path; its name."""
        name = f"substrings_{uuid.uuid4().hex}"
        self.tables.append(name)
        atexit.register(self._drop, name)  # the catalog may outlive the session
        df.write.bucketBy(self.buckets, by).sortBy(*order).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _union(self, names: list[str], *columns: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(n).select(*columns) for n in names])

    def history(self) -> DataFrame | None:
        """(a, s, d) of all runs: a stretch and the smallest document that has it."""
        return self._union(self.runs, "a", "s", "d", "kind").where("kind in (0, 2)").drop("kind") if self.runs else None

    def _drop(self, name: str) -> None:
        """Take a table out of the catalog and delete its files; a session that is stopped has no catalog any more."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the JVM may be gone
            return
        remove(self.spark, f"{self.path}/{name}")

    def clear_merged(self) -> None:
        """Delete runs that were compacted, once the results of their batches have been written."""
        for name in self.merged:
            self._drop(name)
        self.merged = []

    def close(self) -> None:
        """Delete all tables of the index, once the results of all batches have been written. What is left is deleted when the driver's Python ends."""
        for name in self.tables:
            self._drop(name)
        self.tables, self.runs, self.texts, self.merged = [], [], [], []

    def compact(self) -> None:
        """Merge all runs into one. They are dealt by bucket before the write: Spark deals a union of runs by (a, s), and each task then wrote a file for every bucket."""
        if len(self.runs) > 1:
            least = self.history().repartition(self.buckets, "a").groupBy("a", "s").agg(F.min("d").alias("d")).select("a", "s", "d", F.lit(None).cast("long").alias("at"), F.lit(0).cast("byte").alias("kind"))
            old, self.runs = self.runs, [self._table(least, "a", ("a", "s"))]
            self.merged += old  # results that are not read yet still need them

    def _kept(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(d, t, text) of a batch, t a hash that tells texts of one id apart: written, bucketed by d."""
        if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
            raise ValueError(f"{doc_id} must be a whole number")
        raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
        mask = (1 << 63 - _PLACE - self.bits) - 1
        rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(raw).bitwiseAND(mask).alias("t"), raw.alias("text"))
        name = self._table(rows.repartition(self.buckets, "d"), "d", ("d",))
        self.texts.append(name)
        return self.spark.table(name)

    def covers(self, texts: DataFrame, keep: bool = True) -> DataFrame:
        """(d, at): the windows, as stretches, of the batch, the last of self.texts, that an earlier document has. keep: the batch's run is history for the next."""
        width = self.width

        def stretch(h, row, batch):
            return stretches(h, width, text=row)

        def windows(h, row, batch):
            a, first, count = anchored(h, width, text=row)
            named = lambda a, row: a + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # noqa: E731  one that agrees by chance is verified in vain
            ends = batch.column(3).offsets.to_numpy()
            low, high = (int(row[0]), int(row[-1]) + 1) if len(row) else (0, 0)
            asked = batch.column(3).values[ends[low] : ends[high]].to_numpy().view(np.uint64)
            chosen = np.isin(named(a, row[first]), named(asked, np.repeat(np.arange(low, high), np.diff(ends[low : high + 1]))))
            first, count = first[chosen], count[chosen]
            start = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            return *window_hashes(h, start, width), start, np.ones(len(start), np.int64)

        merged, past = texts.mapInArrow(_rows(stretch, self.bits), _ROW).repartition(self.buckets, "a"), self.history()
        if past is not None:  # dealt alike: the runs stay where they are
            merged = merged.unionByName(past.withColumn("at", F.lit(None).cast("long")))
        same, anchor = W.partitionBy("a", "s"), W.partitionBy("a").orderBy("s").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        many = (F.min("s").over(anchor) < F.max("s").over(anchor)) & (F.min("d").over(anchor) < F.max("d").over(anchor))
        merged = merged.select("a", "s", "d", "at", many.alias("many")).withColumn("least", F.min("d").over(same))
        # kind 1: an earlier document has the whole stretch; 2: to be verified by windows, 3 if historical; 0: new
        whole = F.col("at").isNotNull() & ((F.col("at") < 0) | (F.col("d") > F.col("least")))
        kind = F.when(whole, 1).when(F.col("many"), F.when(F.col("at").isNull(), 3).otherwise(2)).otherwise(0)
        merged = merged.select("a", "s", "d", "at", kind.cast("byte").alias("kind")).where("kind > 0" + (" or at is not null" if keep else ""))
        run = self._table(merged.withColumn("at", F.when(F.col("kind") == 1, F.col("at"))), "a", ("a", "s"))
        if keep:
            self.runs.append(run)
            if len(self.runs) >= self.fanout:
                self.compact()
        merged = self.spark.table(run)
        whole = merged.where("kind = 1").select("d", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))
        doubtful = merged.where("kind > 1").groupBy("d").agg(F.collect_set("a").alias("anchors"))
        # joined table by table: a union of them would be dealt anew
        found = reduce(DataFrame.unionByName, [self.spark.table(n).select("d", "t", "text").join(doubtful, "d") for n in self.texts])
        found = found.mapInArrow(_rows(windows, self.bits), _ROW)
        return whole.unionByName(self._repeated(found))

    @staticmethod
    def _repeated(found: DataFrame) -> DataFrame:
        least = F.min("d").over(W.partitionBy("a", "s"))
        found = found.select("d", "at", least.alias("least"))
        return found.where("at < 0 or d > least").select("d", F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"))

    def dedup(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
        """One row per row of the batch docs: doc_id, its words and the removed ones, and the text that is left."""
        width, bits = self.width, self.bits
        texts = self._kept(docs, doc_id, text)
        by_doc = self.covers(texts, keep).groupBy("d").agg(F.collect_list("at").alias("cover"))

        @F.pandas_udf("struct<n_words:long,n_removed:long,kept:binary>")
        def cut(raw: pd.Series, t: pd.Series, cover: pd.Series) -> pd.DataFrame:
            rows = []
            for r, own, c in zip(raw, t, cover, strict=True):
                words, gone = r.split(), 0
                if c is not None and len(c) and len(words) >= width:
                    at = np.asarray(c, np.int64)
                    at = at[at >> _PLACE + bits == own]
                    first, count = at >> bits & (1 << _PLACE) - 1, at & (1 << bits) - 1
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count + width - 1, -1)
                    left = np.cumsum(edge[:-1]) == 0
                    gone = int((~left).sum())
                    kept = b" ".join(compress(words, left.tolist()))
                else:
                    kept = b" ".join(words)
                rows.append((len(words), gone, kept))
            return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

        out = texts.join(by_doc, "d", "left").select(F.when(F.col("d") < LAST, F.col("d")).alias("doc_id"), cut("text", "t", "cover").alias("r"))
        return out.select("doc_id", "r.*")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shares: tuple[float, ...] = SHARES, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """dedup() of all docs, taken in batches by ranges of their ids: doc_id, n_words, n_removed, kept (UTF-8). A batch ends at each of `shares` of the ids."""
    index, ids = SubstringIndex(docs.sparkSession, width=width, fanout=fanout), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    bounds = docs.select(ids.alias("d")).stat.approxQuantile("d", list(shares), 0.001) if shares else []
    bounds, parts = sorted({int(b) for b in bounds}), []
    for k in range(len(bounds) + 1):
        inside = F.lit(True) if k == 0 else ids > bounds[k - 1]
        batch = docs.where(inside & (ids <= bounds[k])) if k < len(bounds) else docs.where(inside)
        parts.append(index.dedup(batch, doc_id, text, keep=k < len(bounds)))
    return reduce(DataFrame.unionByName, parts)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shares: tuple[float, ...] = SHARES) -> DataFrame:
    """One row per row of docs: n_words, n_removed, and the SHA-256 of the words that stay."""
    return deduplicated(docs, doc_id, text, shares).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM docs WHERE len(w) >= 13),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM spot),
seen AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM seen WHERE least < doc_id),
lists AS (SELECT doc_id, list(q) AS g, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM docs d),
kept AS (SELECT o.doc_id, string_agg(x, ' ' ORDER BY o.q) AS t FROM word o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.q = g.q GROUP BY o.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
