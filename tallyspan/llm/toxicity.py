"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the n-grams (NGRAMS code points) that a whole text, lower-cased, has; each is hashed to one of
BUCKETS. A bucket's ratio compares how often labelled documents of either class have it. The SELECT buckets
whose ratio stands out most against chance become features of the value of their ratio, and a logistic
regression with an L2 penalty weighs them. The fit reads at most TRAIN_ROWS labelled documents; what it gives
is a vector of BUCKETS numbers, so its size does not follow the data.

Null and empty texts have no n-grams and get the intercept's score. Without labels of both classes every
score is 0. Repeated rows give repeated results. An empty table gives no rows. Texts of any length are read whole, in one task each. A score of just 0.5 is predicted toxic.
Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.sampling import labelled_texts

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 20
SELECT = 4096
#: Labelled documents that the classifier is fitted on at most.
TRAIN_ROWS = 20_000

_ODD = 0x9E3779B97F4A7C15


def buckets(text: str | None) -> np.ndarray:
    """The hashed n-grams of a whole text, in text order, repeats included."""
    if not text:
        return np.zeros(0, np.int64)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, key = [], chars
    for n in range(2, max(NGRAMS) + 1):
        if len(chars) < n:
            break
        key = key[:-1] * np.uint64(_ODD) + chars[n - 1 :]
        if n in NGRAMS:
            mixed = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(44)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """weight: per bucket, ratio times coefficient."""

    intercept: float
    weight: np.ndarray

    def score(self, texts: pd.Series) -> np.ndarray:
        """The probability of label 1 for each text."""
        chosen, seen = self.weight != 0, np.zeros(len(self.weight), bool)
        margin = np.empty(len(texts))
        for k, text in enumerate(texts):
            b = buckets(text)
            b = b[chosen[b]]
            fresh = b[~seen[b]]
            seen[fresh] = True  # repeats of one bucket count once
            hit = np.unique(fresh)
            seen[fresh] = False
            margin[k] = self.intercept + self.weight[hit].sum()
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def select(docs_with: np.ndarray, toxic_with: np.ndarray, docs: int, toxic: int, most: int = SELECT) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log-count ratios) of the `most` buckets whose ratio is largest in standard errors; ties by bucket."""
    p, q = toxic_with + 1.0, docs_with - toxic_with + 1.0
    ratio = np.log(p / (toxic + 2)) - np.log(q / (docs - toxic + 2))
    sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    sure[docs_with < 3] = 0
    best = np.argsort(-sure, kind="stable")[:most]
    best = np.sort(best[sure[best] > 1.5])
    return best, ratio[best]


def regress(rows: list[np.ndarray], y: np.ndarray, values: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and coefficients by accelerated gradient steps; rows: each document's features as places in values."""
    lengths = np.array([len(r) for r in rows])
    at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    row, x = np.repeat(np.arange(len(rows)), lengths), values[at]
    bound = 0.25 * (np.bincount(row, x * x, len(rows)).mean() * 4 + 1) + penalty
    w = old = np.zeros(len(values))
    b = old_b = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for k in range(steps):
        push = k / (k + 3)
        v, c = w + push * (w - old), b + push * (b - old_b)
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * v[at], len(rows)) + c, -60, 60))) - y
        old, old_b = w, b
        w = v - (np.bincount(at, x * error[row], len(values)) / len(y) + penalty * v) / bound
        b = c - error.mean() / bound
    return float(b), w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, keep=None) -> Model:
    """Fitted on at most `rows` labelled documents that pass keep."""
    some = labelled_texts(docs, labels, label, rows, keep=keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n, mark = np.zeros((2, BUCKETS), np.int32), [0, 0], np.zeros(BUCKETS, bool)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark[:] = False
                mark[buckets(text)] = True
                both[y] += mark
                n[y] += 1
        some = np.flatnonzero(both.any(axis=0))
        b, with_n, with_y = np.append(some, -1), np.append(both[:, some].sum(axis=0), sum(n)), np.append(both[1, some], n[1])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(with_n, pa.int64()), pa.array(with_y, pa.int64())], names=["b", "n", "y"])

    counts = some.mapInArrow(count, "b long, n long, y long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n >= 3 or b < 0").toArrow()
    b, n, y = (counts[c].to_numpy() for c in "bny")
    empty = Model(-60.0, np.zeros(BUCKETS))
    if not len(b) or not 0 < (toxic := int(y[b < 0].sum())) < (total := int(n[b < 0].sum())):
        return empty
    with_n, with_y = np.zeros(BUCKETS), np.zeros(BUCKETS)
    with_n[b[b >= 0]], with_y[b[b >= 0]] = n[b >= 0], y[b >= 0]
    chosen, ratio = select(with_n, with_y, total, toxic)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([(found := np.unique(place[buckets(t)]))[found >= 0] for t in texts], dtype=object)

    got = some.select(features("text").alias("x"), "y").toArrow()
    found = sorted((x, y) for x, y in zip(got["x"].to_pylist(), got["y"].to_pylist(), strict=True))  # the same fit whatever order rows arrive in
    intercept, w = regress([np.array(x, np.int64) for x, _ in found], np.array([y for _, y in found], float), ratio)
    weight = np.zeros(BUCKETS)
    weight[chosen] = ratio * w
    return Model(intercept, weight)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: held_out, score, predicted."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
