"""Token ids in training order: fixed-stride sequences at slots given by a keyed Feistel permutation.

A text is encoded whole, ended by the end id, and cut into sequences of `length` ids, the last one filled up with
the end id. All sequences are numbered in the order of their documents' ids, then texts' hashes; a Feistel network over the next power of
four, walked along its cycle until it lands under the number of sequences, permutes the numbers into slots. Slots are dealt to shards by
range, in order, so a shard is read from front to back and slot s starts at byte (s % per_shard) * stride of its shard.

Documents are dealt by ranges of that order before they are encoded, and the encoded sequences are written once to the shared folder; their
counts by partition give the numbering. So it depends on the documents only: neither a lost executor nor another number of
partitions, files or executors moves a sequence, and a run can be resumed elsewhere.

Null and empty texts have no sequence; an empty table has none at all. Null ids come last. Repeated rows have sequences of their own, which are alike.
Very long texts leave a task in small pieces. Ids are little-endian, of two bytes if the vocabulary allows it. Columns other than the id and the
text are not looked at.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store

#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
LENGTH = 512
PER_SHARD = 8192
KEY = 20_011
#: Shards that one task writes.
SHARDS_A_TASK = 16


class Encoder:
    """Text to little-endian ids."""

    def __init__(self, ranks: bytes, end: int = END):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.kind = "H" if max(self.engine.max_token_value, end) < 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.end = self._bytes([end])

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        return self._bytes(self.engine.encode_ordinary(text))


def permute(numbers: np.ndarray, size: int, key: int = KEY, rounds: int = 6) -> np.ndarray:
    """The slot of each number under `size`: a keyed one-to-one map of range(size) onto itself."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(1, rounds + 1)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            z = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << shift) | right

    out = once(np.asarray(numbers, np.uint64))
    while (far := np.flatnonzero(out >= size)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH) -> DataFrame:
    """(part, number, doc_id, seq_no, n_tokens, tokens): every sequence, numbered within its range of documents. The vocabulary is read on the driver."""
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number = Encoder(ranks.value, end), TaskContext.get().partitionId(), 0
        stride = length * coder.width
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # so that the output of long texts leaves in small pieces
                some = batch.slice(first, 256)
                rows, seqs, counts, tokens = [], [], [], []
                for k, t in enumerate(some.column(1).to_pylist()):
                    ids = coder.encode(t) + coder.end
                    for n, at in enumerate(range(0, len(ids), stride)):
                        piece = ids[at : at + stride]
                        rows.append(k)
                        seqs.append(n)
                        counts.append(len(piece) // coder.width)
                        tokens.append(piece + coder.end * (length - counts[-1]))
                numbers = np.arange(number, number + len(rows))
                number += len(rows)
                ids = some.column(0).take(pa.array(rows, pa.int64()))
                columns = [pa.array(np.full(len(rows), part)), pa.array(numbers), ids, pa.array(seqs, pa.int32()), pa.array(counts, pa.int32()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "doc_id", "seq_no", "n_tokens", "tokens"])

    keyed = slim.select("doc_id", "text", F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_hash"))
    dealt = keyed.repartitionByRange("_none", "doc_id", "_hash").sortWithinPartitions("_none", "doc_id", "_hash")
    return dealt.select("doc_id", "text").mapInArrow(cut, f"part long, number long, doc_id {kind}, seq_no int, n_tokens int, tokens binary")


def materialised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Every sequence at its slot: slot, shard, byte_offset in the shard, doc_id, seq_no, n_tokens, tokens.

    Partitions hold SHARDS_A_TASK whole shards, in slot order.
    """
    rows = store(encoded(docs, doc_id, text, vocabulary, end, length), "sequences")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    total, before = 0, {}
    for part, n in counts:
        before[part] = total
        total += n
    tasks = max(1, -(-total // (per_shard * SHARDS_A_TASK)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.array([before[p] for p in b.column(0).to_pylist()], np.int64)
            slot = permute(start + b.column(1).to_numpy(), total, key)
            stride = b.column(5)[0].as_buffer().size if b.num_rows else 0
            shard, offset = slot // per_shard, slot % per_shard * stride
            columns = [pa.array(slot), pa.array(shard), pa.array(offset), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"slot long, shard long, byte_offset long, doc_id {kind}, seq_no int, n_tokens int, tokens binary")
    return placed.repartitionById(tasks, F.floor(F.col("shard") / SHARDS_A_TASK).cast("int")).sortWithinPartitions("slot")


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    at = urlparse(path)
    return (pyarrow.fs.LocalFileSystem(), at.path) if at.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(path)


_PLACE = ("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens")


def _schema(placed: DataFrame, last: str) -> str:
    return f"slot long, shard long, byte_offset long, doc_id {placed.schema['doc_id'].dataType.simpleString()}, seq_no int, n_tokens int, {last}"


def writing(placed: DataFrame, path: str) -> DataFrame:
    """Writes each shard of materialised() as one file of fixed stride under path, a URI that pyarrow's file systems know, and gives each sequence's place and size.

    A file is written under the task's own name and then moved, so a task that runs again, or twice, leaves the same file.
    Lazy, as any DataFrame: the files are written when it is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(path)
        files.create_dir(base, recursive=True)
        own, now, file = f"{base}/.attempt-{TaskContext.get().taskAttemptId()}", None, None

        def close():
            if file:
                file.close()
                files.move(f"{own}-{now}", f"{base}/shard-{now:06d}.bin")

        for b in batches:
            size = []
            for shard, tokens in zip(b.column(1).to_pylist(), b.column(6), strict=True):
                if now != shard:
                    close()
                    now, file = shard, files.open_output_stream(f"{own}-{shard}")
                size.append(file.write(tokens.as_buffer()))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(size, pa.int64())], names=[*_PLACE, "size"])
        close()

    return placed.select(*_PLACE, "tokens").mapInArrow(write, _schema(placed, "size long"))


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """Writes the shards and gives their index: shard, first_slot, sequences, bytes."""
    return writing(placed, path).groupBy("shard").agg(F.min("slot").alias("first_slot"), F.count("*").alias("sequences"), F.sum("size").alias("bytes"))


def read_back(places: DataFrame, path: str) -> DataFrame:
    """What writing() gave, with each sequence's tokens as the written shards hold them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(path)
        shard, file = None, None
        for b in batches:
            tokens = []
            for of, at, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(6).to_pylist(), strict=True):
                if of != shard:
                    shard, file = of, files.open_input_file(f"{base}/shard-{of:06d}.bin")
                tokens.append(file.read_at(size, at))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(tokens, pa.binary())], names=[*_PLACE, "tokens"])

    return places.select(*_PLACE, "size").mapInArrow(read, _schema(places, "tokens binary"))


def written(docs: DataFrame, path: str, **settings) -> DataFrame:
    """materialised() with every shard written under path at once; the rows' tokens are read from the shards. settings: as for materialised()."""
    return read_back(store(writing(materialised(docs, **settings), path), "places"), path)


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: str = "<u2") -> np.ndarray:
    """`count` sequences from slot `first` on, for a reader that starts or resumes there."""
    files, base = _files(path)
    stride, out = length * np.dtype(dtype).itemsize, []
    while count > 0:
        with files.open_input_file(f"{base}/shard-{first // per_shard:06d}.bin") as file:
            file.seek(first % per_shard * stride)
            got = np.frombuffer(file.read(min(count, per_shard - first % per_shard) * stride), dtype).reshape(-1, length)
        if not len(got):
            break
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros((0, length), dtype)
