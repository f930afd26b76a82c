"""Quality rules: gradient-boosted trees over document statistics, scored as numpy node arrays.

A document's statistics come from one pass over its whole text. The trees are fitted on all labelled documents; features named
in MONOTONE can only push the score one way. Cuts are exact quantiles of all labelled rows, found by one sort by range; then each level of
each tree is a pass over the rows' codes, whose tasks return histograms of gradients in whole numbers, so a fit does not depend on how rows
are dealt. A fitted forest is a set of complete binary trees in three arrays (feature, threshold, leaf value), so scoring is
depth-many vectorised look-ups for all documents of a batch and all trees.

Null and empty texts have zero statistics and fail the base rule (fewer than 10 words). Repeated rows give
repeated results. Without any usable label the verdict is that of the base rule alone. An empty table gives no rows. Texts of any length are
read whole, in one task each. A score at KEEP_AT is kept. Columns other than the id and the text are not looked at, but keep() carries them along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.sampling import usable
from tallyspan.plans.ranks import ranked
from tallyspan.plans.scratch import store

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words", "long_share")
#: -1: more of it never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "mark_share": -1}
TREES, BINS = 80, 32
#: Gradients are summed as whole multiples of 1 / UNIT: exactly for under 2**31 rows.
UNIT = 2.0**32
#: Labelled rows of a task of a pass, about.
TASK_ROWS = 1 << 16
#: Least score that keeps a document.
KEEP_AT = 0.5

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of `width` words which the text has twice or more.

    Windows are compared by a 64-bit mix of their words' numbers; two different ones of a text agree by
    chance about once in 2**64 pairs.
    """
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n) + np.uint64(1)
    if len(numbers) == n:
        return 0
    ids *= np.uint64(_MIX[0])
    ids ^= ids >> np.uint64(29)
    ids *= np.uint64(_MIX[1])
    ids ^= ids >> np.uint64(32)
    key = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        key = key * np.uint64(_MIX[2]) + ids[k : n - width + 1 + k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.isin(key, twice))
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    if not text:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    words, count = raw.split(), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, total = len(words), lambda chars: int(count[list(chars)].sum())
    chars, symbols = len(text) - total(SPACES), total(SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    dup, again = len(lines) - len(set(lines)), repeated_words(words)
    upper, marks = int(count[65:91].sum()), total(b"!?")
    features = [
        np.log1p(n), chars / max(n, 1), symbols / max(chars, 1), dup / max(len(lines), 1), again / max(n, 1), upper / max(chars, 1), int(count[48:58].sum()) / max(chars, 1),
        marks / max(chars, 1), len(set(words)) / max(n, 1), n / max(len(lines), 1), sum(len(w) > 20 for w in words) / max(n, 1),
    ]
    return [n, chars, symbols, dup, again], [float(x) for x in features]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rule: fewer than 10 words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Forest:
    """Complete trees of one depth. feature, threshold: trees x inner nodes; value: trees x leaves; a row goes right if above."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(np.asarray(x, np.float64))))


def _quantiles(n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) among n sorted values that inner bounds of `bins` equal parts lie at or behind, and how far behind."""
    at = np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)
    return np.floor(at).astype(np.int64), at - np.floor(at)


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)  # code <= k if x <= cuts[k]


def _histograms(codes: np.ndarray, y: np.ndarray, bias: float, feature: np.ndarray, code: np.ndarray, value: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Gradients and curvatures (2 x nodes x features x bins, in 1 / UNIT) of the level's nodes of the last tree given; the trees before are whole."""
    n, width = codes.shape
    rows, margin = np.arange(n), np.full(n, bias)
    for t, (f, c) in enumerate(zip(feature, code, strict=True)):
        last, at = t == len(feature) - 1, np.zeros(n, np.int64)
        for _ in range(level if last else (len(f) + 1).bit_length() - 1):
            at = 2 * at + 1 + (codes[rows, f[at]] > c[at])
        if not last:
            margin += value[t][at - len(f)]
    p = 1 / (1 + np.exp(-margin))
    node, nodes = (at - (2**level - 1)) * bins, 2**level
    out = np.zeros((2, nodes, width, bins), np.int64)
    for k, v in enumerate((np.rint((y - p) * UNIT), np.rint(p * (1 - p) * UNIT))):
        for first in range(0, n, 1 << 20):  # so many whole numbers have an exact sum in doubles
            part = slice(first, first + (1 << 20))
            for j in range(width):
                out[k, :, j] += np.bincount(node[part] + codes[part, j], v[part], nodes * bins).astype(np.int64).reshape(nodes, bins)
    return out


def grow(cuts: list[np.ndarray], share: float, sums: Callable[..., np.ndarray], trees: int = TREES, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0, signs: tuple[int, ...] = ()) -> Forest:
    """Second-order boosting on the logistic loss with histogram splits, a call of sums for each level of each tree: _histograms() of all rows.

    signs: per feature -1, 0 or 1. A split on a signed feature must order its sides' values that way, and both
    sides then stay on their side of the midpoint, so no later split can undo the order.
    """
    signs, share = signs or (0,) * len(cuts), np.clip(share, 1e-3, 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    code = np.full((trees, inner), 255)  # none is above
    for k in range(trees):
        bounds, total = {0: (-np.inf, np.inf)}, {}
        for level in range(depth):
            grads, hesses = sums(forest.bias, forest.feature[: k + 1], code[: k + 1], forest.value[: k + 1], level) / UNIT
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                low, high = bounds[at]
                bounds[2 * at + 1] = bounds[2 * at + 2] = (low, high)
                grad, hess = grads[at - (2**level - 1)], hesses[at - (2**level - 1)]
                g, h = grad[0].sum(), hess[0].sum()
                total[2 * at + 1], total[2 * at + 2] = (g, h), (0.0, 0.0)
                best, chosen = 1e-6, None
                for j in range(len(cuts)):
                    if not len(cuts[j]):
                        continue
                    gl, hl = np.cumsum(grad[j])[: len(cuts[j])], np.cumsum(hess[j])[: len(cuts[j])]
                    gr, hr = g - gl, h - hl
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                    gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl**2 - (hr + ridge) * vr**2 - g**2 / (h + ridge)
                    gain[(hl < least) | (hr < least) | (signs[j] * (vr - vl) < 0)] = -np.inf
                    if gain.max(initial=-np.inf) > best:
                        best, b = float(gain.max()), int(gain.argmax())
                        chosen = j, b, float(vl[b] + vr[b]) / 2, (gl[b], hl[b]), (gr[b], hr[b])
                if chosen:
                    j, b, middle, left, right = chosen
                    forest.feature[k, at], forest.threshold[k, at], code[k, at] = j, cuts[j][b], b
                    total[2 * at + 1], total[2 * at + 2] = left, right
                    if signs[j]:
                        sides = ((low, middle), (middle, high))
                        bounds[2 * at + 1], bounds[2 * at + 2] = sides if signs[j] > 0 else ((middle, high), (low, middle))
        for i in range(leaves):
            g, h = total[inner + i]
            forest.value[k, i] = rate * np.clip(g / (h + ridge), *bounds[inner + i])
    return forest


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = 3, bins: int = BINS, signs: tuple[int, ...] = (), **options: float) -> Forest:
    """grow() over rows that are all at hand; train() does the same over tables of any size."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    at, past = _quantiles(len(x), bins)
    order = np.sort(x, axis=0)
    cuts = [_cuts(order[at, j], order[np.minimum(at + 1, len(x) - 1), j], past) for j in range(x.shape[1])]
    codes = _codes(x, cuts)
    return grow(cuts, y.mean(), lambda *model: _histograms(codes, y, *model, bins), trees, depth, signs=signs, **options)


def _cuts(low: np.ndarray, high: np.ndarray, past: np.ndarray) -> np.ndarray:
    return np.unique(low + (high - low) * past)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None, trees: int = TREES, bins: int = BINS) -> Forest | None:
    """A forest fitted on all labelled documents; None if their labels don't differ. Statistics, not texts, meet the labels, so no text is shuffled."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in texts], dtype=object)

    found = docs.select(F.col("doc_id").alias("lid"), features("text").alias("x")).join(usable(labels, label, keep), "lid")
    rows = store(found.select("x", F.when(F.col("y") > 0, 1).otherwise(0).cast("long").alias("y")), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if ones in (0, n):
        return None
    at, past = _quantiles(n, bins)
    wanted = {int(j * n + p): j for j in range(len(FEATURES)) for p in (*at, *np.minimum(at + 1, n - 1))}
    spread = rows.select(F.monotonically_increasing_id().alias("i"), F.posexplode("x").alias("j", "v"))  # equal values may fall anywhere, but not all in one task
    placed = ranked(spread, [F.col("j"), F.col("v"), F.col("i")], "place", 0)
    value = {r["place"]: r["v"] for r in placed.where(F.col("place").isin(list(wanted))).select("place", "v").collect()}  # two for each cut
    cuts = [_cuts(*(np.array([value[int(j * n + p)] for p in side]) for side in (at, np.minimum(at + 1, n - 1))), past) for j in range(len(FEATURES))]
    width = len(FEATURES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = _codes(b.column(0).flatten().to_numpy().reshape(b.num_rows, width), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in codes], pa.binary()), b.column(1)], names=["c", "y"])

    coded = store(rows.coalesce(-(-n // TASK_ROWS)).mapInArrow(encode, "c binary, y long"), "codes")

    def sums(bias: float, feature: np.ndarray, code: np.ndarray, leaf: np.ndarray, level: int) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2**level, width, bins), np.int64)
            for b in batches:
                codes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, width)
                total += _histograms(codes, b.column(1).to_numpy(), bias, feature, code, leaf, level, bins)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

        parts = coded.mapInArrow(part, "m binary").collect()  # 45 kB a task at most
        return sum(np.frombuffer(r["m"], np.int64).reshape(2, 2**level, width, bins) for r in parts)

    return grow(cuts, ones / n, sums, trees, signs=tuple(MONOTONE.get(f, 0) for f in FEATURES))


def _judge(texts: pd.Series, forest: Forest | None, keep_at: float) -> pd.DataFrame:
    both = [statistics(t) for t in texts]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(BASE))
    failed = base_failed(counts)
    score = forest.score(np.array([f for _, f in both]).reshape(-1, len(FEATURES))) if forest else np.ones(len(both))
    return pd.DataFrame(counts, columns=list(BASE)).assign(base_failed=failed, score=score, kept=~failed & (score >= keep_at))


def judge(docs: DataFrame, forest: Forest | None, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of docs: base counts, base_failed, the forest's score, and whether the document is kept."""

    @F.pandas_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,score:double,kept:boolean>")
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return _judge(texts, forest, keep_at)

    return docs.select(F.col(doc_id).alias("doc_id"), verdict(F.col(text)).alias("r")).select("doc_id", "r.*")


def keep(docs: DataFrame, forest: Forest | None, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that pass, with all their columns."""

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return _judge(texts, forest, keep_at)["kept"]

    return docs.where(passes(F.col(text)))
