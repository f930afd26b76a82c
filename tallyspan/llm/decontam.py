"""Benchmark decontamination by latent semantic retrieval.

Words, lower-cased, are hashed once to BUCKETS features, which are written to the shared folder; document frequencies are counted over all documents. A
randomised singular value decomposition of the TF-IDF passages of all documents and all benchmark items, which together weigh ITEMS
times as much as the documents, is computed by tasks that each add up their part of A'(A X) for a thin X, in turn with an orthogonalisation of
that thin matrix. Every passage of every document is then projected, and its cosine to each item's projection
is taken. Candidates are verified on the words themselves: the longest common subsequence of the item and
the text around the passage must hold COVER of the item's words, or LEAST of them if the item's answer, its last
sentence, stands there too.

Passages come in three lengths, half overlapping; an item is searched among passages of about its own length, a long
one by pieces. Items are dealt by a hash into blocks of about BLOCK words. Each block is searched for in a pass of its own over all
documents, which broadcasts that block alone; what it finds is written to the shared folder.

Null and empty texts are clean, items without words match nothing, and without items or documents nothing is found. Repeated rows are judged
alike; rows that share an id are told apart by their texts. Ids of documents and items may be of any type. A long text's passages are multiplied with the items
in slices of SLICE. Only the id and the text of documents are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.hashing import LETTERS, places, word_hashes
from tallyspan.plans.scratch import store

BUCKETS_BITS = 14
BUCKETS = 1 << BUCKETS_BITS
RANK, EXTRA, ROUNDS = 56, 8, 2
#: Leading directions that are damped: they hold what all texts of a language share, and would make all passages alike. An item that so
#: many documents repeat that it has such a direction to itself still stands out from what little else it has.
SHARED, DAMPED = 8, 0.25
#: What all items weigh in the decomposition, as a part of what all documents weigh. Without it their own words would be lost among those of many documents.
ITEMS = 1 / 3
#: Passage lengths in words, each twice the last; the hop of each is half its length.
LENGTHS = (16, 32, 64)
STEP = LENGTHS[0] // 2
#: Least cosine of a candidate.
COSINE = 0.6
COVER, LEAST = 0.75, 0.5
#: Words of items that are searched in one pass, about.
BLOCK = 1 << 20
#: Passages that are multiplied with all pieces of a block at once.
SLICE = 4096
#: Passages of a task of the decomposition, which hands on one matrix of BUCKETS x (SHARED + RANK + EXTRA) at most, in parts of PART features; passages that are multiplied at once, and words of the texts that they are cut from.
TASK, PART, ROWS, WORDS = 1 << 17, 256, 1024, 1 << 18
#: Buckets that stand more often in ROWS passages are counted in a matrix.
OFTEN = 32

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hashes(raw: bytes) -> np.ndarray:
    return word_hashes(raw, *places(raw, LETTERS))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(words): the buckets of each text's words, two bytes each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bucket(_hashes(_lowered(t))).astype("<u2").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], names=["words"])

    return store(docs.select(F.col(text).alias("t")).mapInArrow(of, "words binary"), "hashed")


def frequencies(words: DataFrame) -> tuple[np.ndarray, int, int]:
    """(texts that have each bucket, texts, passages of the longest length) of hashed() texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, cut, mark = np.zeros(BUCKETS, np.int64), 0, 0, np.zeros(BUCKETS, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                mark[:] = False
                b = np.frombuffer(t, "<u2")
                mark[b] = True
                seen += mark
                n, cut = n + 1, cut - (-len(b) // LENGTHS[-1])
        b = np.concatenate([np.flatnonzero(seen), [-1, -2]])
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.concatenate([seen[b[:-2]], [n, cut]]))], names=["b", "n"])

    got = words.select("words").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    b, n = got["b"].to_numpy(), got["n"].to_numpy()
    out[b[b >= 0]] = n[b >= 0]
    return out, int(n[b == -1].sum()), int(n[b == -2].sum())


def _pieces(h: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(passage length, words) of an item: whole if it fits one length, else pieces of three quarters of the longest."""
    if len(h) <= LENGTHS[-1]:
        return [(next(n for n in LENGTHS if len(h) <= n * 3 / 2 or n == LENGTHS[-1]), h)] if len(h) else []
    step = LENGTHS[-1] * 3 // 4
    return [(LENGTHS[-1], h[k : k + step]) for k in range(0, len(h) - step // 2, step)]


def _cut(texts: list[bytes], weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages x LENGTHS[-1] buckets, their texts' weights) of hashed texts, some texts at a time. Where a text ends the rest of its last passage is BUCKETS."""
    wide, sizes = LENGTHS[-1], np.array([len(t) // 2 for t in texts], np.int64)
    group = np.cumsum(sizes) // WORDS
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = sizes[low:high]
        many = -(-own // wide)
        flat = np.frombuffer(b"".join(texts[low:high]), "<u2")
        out = np.full(int(many.sum()) * wide, BUCKETS, np.uint16)
        out[np.arange(len(flat)) + np.repeat((np.cumsum(many) - many) * wide - (np.cumsum(own) - own), own)] = flat
        yield out.reshape(-1, wide), np.repeat(weights[low:high], many)


def _squares(passages: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The squared length of each TF-IDF passage: a bucket that stands n times counts n * n, once for each place and twice for each two of them."""
    s, square, rows = np.sort(passages, axis=1), idf.astype(float) ** 2, np.arange(len(passages))
    total = square[s].sum(axis=1)
    for k in range(1, s.shape[1]):
        at, place = np.nonzero((s[:, k:] == s[:, :-k]) & (s[:, k:] < BUCKETS))
        if not len(at):
            break
        total += np.bincount(rows[at], 2 * square[s[at, place + k]], len(total))
        left = np.unique(at)  # places further apart are alike in these only
        s, rows = s[left], rows[left]
    return total


def gram_times(passages: np.ndarray, scale: np.ndarray, x: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A x) to total, for A the counts of buckets in passages, times the roots of scale. x has a last row for BUCKETS, which is zero; total's last row means nothing.

    Of buckets that stand often in the passages a matrix of counts is multiplied, of the others all first places are added, then all second ones, and so on.
    """
    wide = passages.shape[1]
    for base in range(0, len(passages), ROWS):
        some = passages[base : base + ROWS]
        y = x[some[:, 0]]
        for k in range(1, wide):
            y += x[some[:, k]]
        y *= scale[base : base + ROWS, None]
        flat = some.ravel()
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], order // wide
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        held = np.diff(np.append(first, len(flat)))
        if len(many := np.flatnonzero(held > OFTEN)):
            at = np.repeat(np.arange(len(many)), held[many]) * len(y) + row[np.repeat(held > OFTEN, held)]
            total[flat[first[many]]] += np.bincount(at, minlength=len(many) * len(y)).reshape(len(many), -1).astype(np.float32) @ y
        few = np.flatnonzero(held <= OFTEN)
        few = few[np.argsort(-held[few], kind="stable")]
        first, held = first[few], held[few]
        sums = y[row[first]]
        for k in range(1, int(held.max(initial=0))):
            upto = int(np.searchsorted(-held, -k))
            sums[:upto] += y[row[first[:upto] + k]]
        total[flat[first]] += sums


def decompose(words: DataFrame, items: DataFrame, seen: np.ndarray, cut: int, idf: np.ndarray) -> np.ndarray:
    """SHARED + RANK leading right singular vectors (BUCKETS x their number), the first SHARED damped, of the TF-IDF matrix of the passages of all documents and items, both hashed(). seen, cut: frequencies() of the documents."""
    own, _, parts = frequencies(items)
    used, wide = np.flatnonzero(seen + own), SHARED + RANK + EXTRA
    held = np.append(idf, 0).astype(np.float32)
    weighed = words.select("words", F.lit(1.0).alias("w")).coalesce(max(1, -(-cut // TASK))).unionByName(items.select("words", F.lit(max(1.0, ITEMS * cut / max(parts, 1))).alias("w")).coalesce(max(1, -(-parts // TASK))))

    def passages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for passages, weights in _cut(batch.column(0).to_pylist(), batch.column(1).to_numpy()):
                scale = (weights / np.maximum(_squares(passages, held), 1e-20)).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (passages.astype("<u2"), scale)], names=["passages", "scale"])

    every = store(weighed.mapInArrow(passages_of, "passages binary, scale binary"), "passages").coalesce(-(-cut // TASK) + -(-parts // TASK) or 1)

    def times(x: np.ndarray) -> np.ndarray:
        scaled = held[:, None] * np.vstack([x, np.zeros((1, wide), np.float32)])

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((BUCKETS + 1, wide), np.float32)
            for batch in batches:
                for passages, scale in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    gram_times(np.frombuffer(passages, "<u2").reshape(-1, LENGTHS[-1]), np.frombuffer(scale, "<f4"), scaled, total)
            told = (held[:, None] * total)[used]
            blocks = [told[k : k + PART].tobytes() for k in range(0, len(told), PART)]
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(np.full(len(blocks), at)), pa.array(blocks, pa.binary())], names=["k", "task", "m"])

        def added(key: tuple, t: pa.Table) -> pa.Table:
            each = [m for _, m in sorted(zip(t["task"].to_pylist(), t["m"].to_pylist(), strict=True))]  # in one order, so that reruns agree
            return pa.table({"k": [key[0].as_py()], "m": pa.array([sum(np.frombuffer(m, np.float32).astype(float) for m in each).astype(np.float32).tobytes()], pa.binary())})

        sums = every.mapInArrow(part, "k long, task long, m binary").groupBy("k").applyInArrow(added, "k long, m binary").collect()  # one matrix in all
        out = np.zeros((BUCKETS, wide), np.float32)
        out[used] = np.frombuffer(b"".join(r["m"] for r in sorted(sums, key=lambda r: r["k"])), np.float32).reshape(-1, wide)
        return out

    q = np.linalg.qr(np.random.default_rng(7).standard_normal((BUCKETS, wide)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        q = np.linalg.qr(times(q))[0].astype(np.float32)
    values, turn = np.linalg.eigh(q.T @ times(q))
    found = q @ turn[:, ::-1][:, : SHARED + RANK]
    found[:, :SHARED] *= DAMPED
    return np.ascontiguousarray(found, np.float32)


def common(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, a word of `words` at a time on bit sets."""
    where: dict[bytes, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if m := where.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def block_of(rows: list[tuple], weight: np.ndarray) -> dict:
    """Items to search for: their ids, words, hash sets and answers, by passage length the pieces' projections, and the buckets of all hash sets, end to end.
    weight: per bucket its idf times its projection."""
    words, hashes, answers, found, pieces = [], [], [], {}, {}
    for k, (_, text) in enumerate(rows):
        raw = _lowered(text)
        h = _hashes(raw)
        words.append(_WORD.findall(raw))
        hashes.append(np.unique(h))
        answers.append(next((w for part in reversed(re.split(rb"[.!?\n]", raw)) if (w := _WORD.findall(part))), []))
        for length, piece in _pieces(h):
            found.setdefault(length, []).append((k, weight[_bucket(piece)].sum(axis=0)))
    for length, some in found.items():
        m = np.array([v for _, v in some], np.float32)
        pieces[length] = np.array([k for k, _ in some]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    worded = np.array([k for k, h in enumerate(hashes) if len(h)], np.int64)
    sizes = np.array([len(hashes[k]) for k in worded], np.int64)
    own = _bucket(np.concatenate([hashes[k] for k in worded])) if len(worded) else np.zeros(0, np.int64)
    return {"ids": [i for i, _ in rows], "words": words, "hashes": hashes, "answers": answers, "pieces": pieces, "worded": worded, "own": own, "starts": np.cumsum(sizes) - sizes, "needed": LEAST * sizes}


def possible(block: dict, buckets: np.ndarray) -> np.ndarray:
    """For each item whether enough of its buckets are among those of a text: no passage of another text holds enough of its words."""
    out, held = np.zeros(len(block["ids"]), bool), np.zeros(BUCKETS, np.uint16)
    if len(block["worded"]):
        held[buckets] = 1
        out[block["worded"]] = np.add.reduceat(held[block["own"]], block["starts"], dtype=np.int64) >= block["needed"]
    return out


def _steps(buckets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of the weights of each STEP words, a place of all steps at a time."""
    full = len(buckets) // STEP * STEP
    placed = buckets[:full].reshape(-1, STEP)
    total = weight[placed[:, 0]]
    for k in range(1, STEP):
        total += weight[placed[:, k]]
    return np.concatenate([total, weight[buckets[full:]].sum(axis=0, keepdims=True)]) if full < len(buckets) else total


def _held(own: np.ndarray, around: np.ndarray) -> int:
    """How many of the sorted, distinct hashes are among others."""
    at = np.minimum(np.searchsorted(own, around), len(own) - 1)
    seen = np.zeros(len(own), bool)
    seen[at[own[at] == around]] = True
    return int(seen.sum())


def passages(steps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, sums of the passages of that length), each from the last by adding neighbours; the text's end cuts the last ones off."""
    now = steps
    for length in LENGTHS:
        gap = 1 if length == LENGTHS[0] else 2
        now = np.concatenate([now, np.zeros((gap, now.shape[1]), now.dtype)])
        now = now[:-gap:gap] + now[gap::gap][: len(now[:-gap:gap])]
        yield length, now


def search(block: dict, raw: bytes, weight: np.ndarray, cosine: float = COSINE) -> list[tuple]:
    """(item's id, share of its words in order, answer found) of the items that a whole lower-cased text contains."""
    starts, ends = places(raw, LETTERS)
    h = word_hashes(raw, starts, ends)
    if not len(h):
        return []
    buckets = _bucket(h)
    may = possible(block, buckets)
    if not may.any():
        return []
    steps = _steps(buckets, weight)
    best: dict[int, tuple[float, bool]] = {}
    tried: set[tuple[int, int]] = set()
    for length, found in passages(steps):
        if length not in block["pieces"]:
            continue
        (items, pieces), hop = block["pieces"][length], length // 2
        some = np.flatnonzero(may[items])
        if not len(some):
            continue
        items, pieces = items[some], pieces[some].T
        norm = np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]
        for base in range(0, len(found), SLICE):
            near = found[base : base + SLICE] @ pieces >= np.maximum(cosine * norm[base : base + SLICE], 1e-9)
            for row, col in zip(*np.nonzero(near), strict=True):
                item = int(items[col])
                first, size = (base + int(row)) * hop, len(block["words"][item])
                low, high = max(0, first - size), min(len(h), first + length + size)
                if best.get(item, (0,))[0] >= 1 or (item, low) in tried:
                    continue
                tried.add((item, low))
                own, around = block["hashes"][item], h[low:high]
                if _held(own, around) < LEAST * len(own):
                    continue
                words = [raw[s:e] for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                share, answer = common(block["words"][item], words) / size, block["answers"][item]
                stands = len(answer) >= 3 and any(words[k : k + len(answer)] == answer for k in range(len(words) - len(answer) + 1))
                if (share >= COVER or share >= LEAST and stands) and (share, stands) > best.get(item, (0.0, False)):
                    best[item] = share, stands
    return [(block["ids"][k], s, a) for k, (s, a) in sorted(best.items())]


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> tuple[DataFrame, int]:
    """(i, t, block) of the items with an id and a text, and the number of blocks."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t <> ''")
    words = rows.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    many = -(-words // BLOCK)
    return rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, many)))), many


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("t"))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, hash of the text, item_id, share, answer): the items that the texts of docs contain; each once for rows that are alike."""
    items, many = _items(benchmark, item_id, item_text)
    kind = items.schema["i"].dataType.simpleString()
    weight = None
    if many:
        words = hashed(docs, text)
        seen, n, cut = frequencies(words)
        idf = (np.log((1 + n) / (1 + seen)) ** 2).astype(np.float32)  # squared, as rare words tell passages apart
        weight = idf[:, None] * decompose(words, hashed(items, "t"), seen, cut, idf)
    rows, parts = _keyed(docs, doc_id, text), []
    for number in range(many):
        own = sorted((tuple(r) for r in items.where(F.col("block") == number).select("i", "t").collect()))  # about BLOCK words
        parts.append(store(_pass(rows, own, weight, kind), "matches"))
    none = rows.where("false").select("doc_id", "hash", F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("share"), F.lit(False).alias("answer"))
    return reduce(DataFrame.unionByName, parts, none).groupBy("doc_id", "hash", "item_id").agg(F.max("share").alias("share"), F.max("answer").alias("answer"))


def _pass(rows: DataFrame, own: list[tuple], weight: np.ndarray, kind: str) -> DataFrame:
    """The matches of one block's items. The block and the model travel by value, so that executors need not have this package."""
    model = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((block_of(own, weight), weight)))

    @F.pandas_udf(f"array<struct<item_id:{kind},share:double,answer:boolean>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block, w = cloudpickle.loads(model.value)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "share": s, "answer": a} for i, s, a in search(block, _lowered(t), w)] for t in texts], dtype=object)

    return rows.where("t <> ''").select("doc_id", "hash", F.explode(found("t")).alias("m")).select("doc_id", "hash", "m.*")


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: contaminated, the ids of the items found, and the best share of an item's words."""
    found = matches(docs, benchmark, doc_id, text)
    of = found.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list("item_id")).alias("items"), F.max("share").alias("share")).withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    rows = _keyed(docs, doc_id, text).drop("t").join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    items = F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit(""))
    return rows.select("doc_id", F.col("items").isNotNull().alias("contaminated"), items.alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    found = matches(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("_row"))
    own = lambda c: F.col("_row")[c]
    same = own(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(own(text), F.lit(""))) == F.col("_hash"))
    return rows.join(found, same, "left_anti").select("_row.*")
