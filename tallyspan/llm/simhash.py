"""Near-duplicates by SimHash: a byte-position inverted index with count filtering, verified bit by bit.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at
least 5 positional bytes. The index has one posting list per positional-byte signature: 4 of the 8 positions
with their bytes. The 20 position sets of SIGNATURES are chosen so that any 5 positions contain one of them, so
a pair that reaches the guaranteed minimum meets in a list. (Lists of single bytes would hold a 256th of all
fingerprints each, whose pairs grow with the square of the input.) Within a list the shared positional bytes
of a pair are tallied, pairs under the minimum are dropped, and the rest are verified by their differing bits.

Only distinct fingerprints are indexed, so copies cost nothing. Links found in a list are thinned to a forest
with the same components before they leave the task. A list of more than LIST fingerprints is not compared
pair by pair: see hub_links.

Texts: A-Z is lower-cased, words are runs of anything but space and \\t to \\r, shingles are joined by single
spaces, repeats included; a text with fewer words is one shingle. Null and empty texts have fingerprint 0 and
are linked like any other. Rows with the same id keep their own fingerprints; a null id never names a class,
and a class of null ids only has a null class id. An empty table gives no rows. Texts of any length are read whole, in one task each.
Columns other than the id and the text are not looked at, but deduplicated() carries them along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.components import components, forest
from tallyspan.llm.hashing import NOT_SPACE, mixed, places, rolled, word_hashes
from tallyspan.llm.hot import HUBS, with_hubs
from tallyspan.plans.scratch import store

SEED = 42
BITS = 3
#: Positional bytes that two fingerprints with at most BITS differing bits share at least.
SHARED = 8 - BITS
#: Longest posting list that is compared pair by pair.
LIST = 2048


def _signatures() -> list[tuple[int, ...]]:
    """Sets of 4 of the 8 positions such that any 5 positions contain one.

    The positions lie in a cycle of three groups; a set is taken if it lies in one group or has three positions in
    one group and the fourth in the next. The property is checked below.
    """
    group = {p: k for k, some in enumerate(((0, 1, 2), (3, 4, 5), (6, 7))) for p in some}

    def taken(four: tuple[int, ...]) -> bool:
        n = [sum(group[p] == k for p in four) for k in range(3)]
        return any(n[k] == 4 or n[k] == 3 and n[(k + 1) % 3] == 1 or n[k] == 2 and n[(k + 1) % 3] == 2 for k in range(3))

    return [four for four in combinations(range(8), 4) if taken(four)]


SIGNATURES = _signatures()
if not all(any(set(four) <= set(five) for four in SIGNATURES) for five in combinations(range(8), SHARED)):
    raise AssertionError("a pair could be missed")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width or None], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text).cast("binary")).alias("fp"))


def _tally(x: np.ndarray) -> np.ndarray:
    """Zero bytes of each row of xors: the positional bytes that a pair shares."""
    return (x.view(np.uint8).reshape(len(x), -1) == 0).sum(axis=1)


def list_links(fps: np.ndarray, lists: np.ndarray, bits: int = BITS, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Links within posting lists, thinned to a forest, as places in fps (rows of one or more 64-bit words). Members of a list are neighbours, lists tells them apart.

    Compares each member with the one `off` places on, for all lists at once, until no list is that long.
    """
    n, off, root = len(fps), 1, np.arange(len(fps))
    left = np.arange(n - 1)
    while len(left := left[left + off < n]) and len(left := left[lists[left] == lists[left + off]]):
        x = fps[left] ^ fps[left + off]
        good = np.flatnonzero(_tally(x) >= shared)
        good = good[np.bitwise_count(x[good]).sum(axis=1, dtype=np.int64) <= bits]
        if len(good):
            u, v = root[left[good]], root[left[good] + off]
            if (apart := u != v).any():
                root = forest(u[apart], v[apart], n)[root]
        off += 1
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(fps: DataFrame) -> DataFrame:
    """(sig, key, fp): each fingerprint in the list of each of its signatures; the key is its bytes there, the others zero. Position 0 is the highest byte."""
    kept = [_signed(sum(255 << 8 * (7 - p) for p in four)) for four in SIGNATURES]
    lists = [F.struct(F.lit(k).cast("byte").alias("sig"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")) for k, mask in enumerate(kept)]
    return fps.select("fp", F.explode(F.array(*lists)).alias("s")).select("s.sig", "s.key", "fp")


def _in_lists(bits: int, longest: int):
    """Runs over postings in list order: links of short lists, and members of longer ones with the list as fourth and fifth column."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        rest, over = (empty, empty, empty), None  # the list that is still open; over: it is known to be long

        def made(a, b, sig, key):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, sig, key)], names=["a", "b", "sig", "key"])

        def closed(sig, key, fp):
            edge = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
            lists = np.cumsum(edge) - 1
            long = np.bincount(lists)[lists] > longest
            if long.any():
                yield made(fp[long], fp[long], sig[long], key[long])
            short = fp[~long]
            a, b = list_links(short.view(np.uint64)[:, None], lists[~long], bits)
            none = np.full(len(a), -1)
            yield made(short[a], short[b], none, none)

        for batch in batches:
            sig, key, fp = (np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for r, c in zip(rest, batch.columns, strict=True))
            if over is not None:  # the open list was long already
                same = int(((sig == over[0]) & (key == over[1])).argmin()) if not ((sig == over[0]) & (key == over[1])).all() else len(sig)
                if same:
                    yield made(fp[:same], fp[:same], sig[:same], key[:same])
                sig, key, fp = sig[same:], key[same:], fp[same:]
                over = over if not len(fp) else None
            if len(fp):
                last = int(np.flatnonzero((sig != sig[-1]) | (key != key[-1])).max(initial=-1)) + 1
                if last:
                    yield from closed(sig[:last], key[:last], fp[:last])
                rest = sig[last:], key[last:], fp[last:]
                if len(rest[0]) > longest:
                    over = rest[0][-1], rest[1][-1]
                    yield made(rest[2], rest[2], rest[0], rest[1])
                    rest = empty, empty, empty
            else:
                rest = empty, empty, empty
        if len(rest[0]):
            yield from closed(*rest)

    return links


def hub_links(members: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) within long lists (sig, key, fp), linear in their members.

    For fingerprints a and b that differ in at most 3 bits there is a value x, within 1 bit of a and 2 of b, with
    the list's four bytes. So each x is given the smallest fingerprint within 1 bit of it as its hub, and every
    fingerprint within 2 bits is linked to that hub: each such link is of at most 3 bits, and a and b get the
    same hub.
    """
    if bits != 3:
        raise ValueError("hubs are laid out for 3 bits")
    free = [[8 * (7 - p) + b for p in range(8) if p not in four for b in range(8)] for four in SIGNATURES]
    flips = lambda some, k: [_signed(sum(1 << b for b in c)) for c in combinations(some, k)]
    table = lambda *ks: F.array(*[F.array(*[F.lit(m).cast("long") for k in ks for m in flips(some, k)]) for some in free])
    step = lambda *ks: members.select("fp", F.explode(F.element_at(table(*ks), F.col("sig").cast("int") + 1)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("x"))
    near = step(0, 1)
    hubs = near.groupBy("x").agg(F.min("fp").alias("hub"))
    return near.unionByName(step(2)).join(hubs, "x").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(fps: DataFrame, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) with the same components as all pairs of at most `bits` differing bits."""
    if not 0 <= bits <= BITS:
        raise ValueError("the index guarantees shared bytes up to 3 bits")
    postings, total = _postings(fps), len(SIGNATURES) * fps.count()
    # lists with a large share of all postings, fewer than HUBS, are known before anything is dealt by list
    huge = postings.groupBy("sig", "key").agg(F.count("*").alias("n")).where(F.col("n") > max(longest, total // HUBS))
    huge = F.broadcast(store(huge.select("sig", "key"), "huge"))
    rest = postings.join(huge, ["sig", "key"], "left_anti")
    found = rest.repartition("sig", "key").sortWithinPartitions("sig", "key", "fp").mapInArrow(_in_lists(bits, longest), "a long, b long, sig long, key long")
    found = store(found, "links")
    short, long = found.where("sig < 0").select("a", "b"), found.where("sig >= 0").select("sig", "key", F.col("a").alias("fp"))
    long = long.unionByName(postings.join(huge, ["sig", "key"]).select(F.col("sig").cast("long"), "key", "fp"))
    return short if long.isEmpty() else short.unionByName(hub_links(long, bits))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS, longest: int = LIST) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: the smallest id that links reach."""
    rows = store(fingerprints(docs, doc_id, text, width), "fingerprints")
    own = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    of = components(links(own.select("fp"), bits, longest)).withColumnRenamed("node", "fp")
    named = store(own.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    table = with_hubs(named.select("fp", "component", "n"), ids, "component", "members", named.count()).select("fp", "component_id", "n")
    return with_hubs(rows, store(table, "classes"), "fp", "n", rows.count()).select("doc_id", "fp", "component_id")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """One row per row of docs: fingerprint as 16 hexadecimal digits, component_id."""
    return classes(docs, doc_id, text, width, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near copies by similarity ---------------------------------------------------------------------------------

#: Words of a shingle. Two texts are near copies if the sets of their shingles have a Jaccard similarity of NEAR or more.
NEAR_WIDTH, NEAR = 5, (4, 5)
#: Words of a wide fingerprint, and the differing bits up to which two of them are candidates. At a similarity of 0.8 about 39 of
#: the 256 bits differ, 48 on texts of four and five shingles, with a deviation of 6; of unlike texts 128. The similarity itself decides.
WIDE = 4
NEAR_BITS = 80
#: Position sets of the wide index: three bytes each.
TRIPLES = [tuple((i + k) % (8 * WIDE) for k in shape) for shape in ((0, 1, 2), (0, 5, 13)) for i in range(8 * WIDE)]
#: Further lists of the index, of texts with the same least shingles in MINIMA orders: two texts of similarity s miss all with probability (1 - s**MINIMA)**LISTS, 3e-5 at 0.8.
LISTS, MINIMA = 20, 4
#: Shingles that at most FEW of the compared sets hold are counted pair by pair; matrices of the others have COLUMNS columns.
FEW, COLUMNS = 16, 1024
_SALTS = mixed(np.arange(1, LISTS * MINIMA + 1, dtype=np.uint64))
_FACTORS = mixed(_SALTS, 7) | np.uint64(1)


def shingle_set(text: bytes | None, width: int = NEAR_WIDTH) -> np.ndarray:
    """Rising hashes of a text's distinct word shingles; a text with fewer words is one shingle."""
    raw = (text or b"").lower()
    h = word_hashes(raw, *places(raw, NOT_SPACE))
    return np.unique(rolled(h, min(width, len(h)))) if len(h) else h


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE words of SimHash over a set of shingles; zeros for an empty one."""
    out = np.zeros(WIDE, np.uint64)
    for w in range(WIDE if len(shingles) else 0):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(shingles), 65536):
            bits = mixed(shingles[k : k + 65536], 0x2545F4914F6CDD1D * (w + 1) % (1 << 64)).view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]
    return out


def least_keys(shingles: np.ndarray) -> np.ndarray:
    """LISTS keys, each of the least shingles in MINIMA orders."""
    low = np.full(LISTS * MINIMA, (1 << 64) - 1, np.uint64)
    for k in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[k : k + 4096, None] ^ _SALTS) * _FACTORS).min(axis=0))
    out = np.zeros(LISTS, np.uint64)
    for column in low.reshape(LISTS, MINIMA).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """For each two of up to some thousand sets (sorted, distinct) how many members they share: a matrix.

    Shingles of few sets are counted pair by pair along the sorted shingles, those of many by products of 0/1 matrices.
    """
    n, size = len(sets), [len(s) for s in sets]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    held = np.diff(np.append(first, len(flat)))
    total = np.zeros(n * n, np.float32)
    few = np.flatnonzero(np.repeat((held > 1) & (held <= FEW), held))
    for k in range(1, FEW):
        few = few[few + k < len(flat)]
        few = few[flat[few] == flat[few + k]]
        if not len(few):
            break
        total += np.bincount(owner[few] * n + owner[few + k], minlength=n * n)
    total = total.reshape(n, n)
    total += total.T
    many = held > FEW
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), held)
    own, column = owner[column >= 0], column[column >= 0]
    edges = np.searchsorted(column, np.arange(0, int(many.sum()) + COLUMNS, COLUMNS))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        if high > low:
            m = np.zeros((n, COLUMNS), np.float32)
            m[own[low:high], column[low:high] % COLUMNS] = 1
            total += m @ m.T
    return total


def similar_links(sets: list[np.ndarray], lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As list_links, but pairs are linked if their sets have a Jaccard similarity of NEAR or more: every pair of a list is compared."""
    root, edge = np.arange(len(sets)), np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if high - low > 1:
            some = sets[low:high]
            common, size = common_shingles(some), np.array([len(s) for s in some], np.float32)
            # the diagonal is left out, so two empty sets are no pair; there is one of them at most
            u, v = np.nonzero(np.triu(NEAR[1] * common >= NEAR[0] * (size[:, None] + size[None, :] - common), 1))
            root[low:high] = low + forest(u, v, high - low)
    at = np.flatnonzero(root != np.arange(len(sets)))
    return at, root[at]


def _compare(bits: int, keys: int, exact: bool):
    """Runs over (`keys` key columns, id, raw) in list order: links (a, b) of ids within each list, thinned to a forest. exact: by the column shingles, not by bits only."""

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def closed(t: pa.Table) -> pa.RecordBatch:
            key = np.stack([c.to_numpy() for c in t.columns[:keys]])
            lists = np.cumsum(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) - 1
            ids = t.column("id").to_numpy()
            if exact:
                a, b = similar_links([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()], lists)
            else:
                a, b = list_links(np.frombuffer(b"".join(t.column("raw").to_pylist()), np.uint64).reshape(-1, WIDE), lists, bits, 0)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = np.stack([c.to_numpy() for c in t.columns[:keys]])
            last = int(np.flatnonzero((key != key[:, -1:]).any(axis=0)).max(initial=-1)) + 1 if t.num_rows else 0
            if last:
                yield closed(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield closed(rest)

    return links_of


def _blocked(members: DataFrame, by: list[str], longest: int) -> DataFrame:
    """(by, x, y, id): members (by, id, n: of how many) of each list.

    One longer than `longest` is cut into blocks, and each two blocks are a list of their own, x and y.
    """
    zero = F.lit(0).cast("long")
    short = members.where(F.col("n") <= longest).select(*by, zero.alias("x"), zero.alias("y"), "id")
    blocks = F.ceil(F.col("n") / (longest // 2)).cast("long")
    mine = F.pmod(F.xxhash64("id", by[0]), blocks)
    long = members.where(F.col("n") > longest).select(*by, "id", mine.alias("mine"), F.explode(F.sequence(zero, blocks - 1)).alias("other"))
    return short.unionByName(long.where("mine <> other").select(*by, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "id"))


def candidate_links(own: DataFrame, bits: int = NEAR_BITS, longest: int = LIST) -> DataFrame:
    """Links (a, b) between ids (id, raw: WIDE words as binary, least: keys) that share a list and differ in at most `bits` bits.

    The lists are of three bytes of the fingerprint, and of equal least shingles. A list longer than `longest` is cut into blocks, and
    each two blocks are compared in a task of their own, so no list has to fit one task and no pair of it is lost.
    """
    key = lambda three: F.conv(F.hex(F.concat(*[F.substring("raw", p + 1, 1) for p in three])), 16, 10).cast("long")
    named = lambda sig, key: F.struct(sig.cast("long").alias("sig"), key.alias("key"))
    lists = F.concat(F.array(*[named(F.lit(k), key(three)) for k, three in enumerate(TRIPLES)]), F.transform("least", lambda v, k: named(k + len(TRIPLES), v)))
    postings = own.select("id", F.explode(lists).alias("s")).select("s.sig", "s.key", "id")
    sizes = postings.groupBy("sig", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = store(postings.join(sizes, ["sig", "key"]), "members")
    at = ("sig", "key", "x", "y")
    every = _blocked(members, ["sig", "key"], longest).join(own.select("id", "raw"), "id").select(*at, "id", "raw")
    return every.repartition(*at).sortWithinPartitions(*at).mapInArrow(_compare(bits, len(at), False), "a long, b long")


def near_links(own: DataFrame, texts: DataFrame, bits: int = NEAR_BITS, longest: int = LIST) -> DataFrame:
    """Links (a, b) between ids of own (id, raw, least, first) whose texts are near copies, with the components of all such pairs that the index connects.

    Candidates connect ids to groups. All texts of a group are compared by their shingles, so a candidate that fails takes no pair with
    it. A group longer than `longest` is cut into blocks like a list. texts: (first, text).
    """

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).tobytes() for t in texts], dtype=object)

    group = components(store(candidate_links(own, bits, longest), "near"))
    sizes = group.groupBy("component").agg(F.count("*").alias("n"))
    members = with_hubs(group.withColumnRenamed("node", "id"), sizes, "component", "n", group.count())
    where = group.select(F.col("node").alias("id")).join(own.select("id", "first"), "id")
    # rows of one id and text are one document
    sets = texts.join(where, "first").groupBy("id").agg(F.first("text").alias("text")).select("id", shingles(F.col("text").cast("binary")).alias("shingles"))
    at = ("component", "x", "y")
    every = _blocked(members, ["component"], longest).join(store(sets, "shingles"), "id").select(*at, "id", "shingles")
    return every.repartition(*at).sortWithinPartitions(*at).mapInArrow(_compare(bits, len(at), True), "a long, b long")


def _order(c: Column) -> Column:
    """Any id's place: nulls after all others, the rest by their own order."""
    return F.struct(c.isNull().alias("none"), c.alias("id"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = NEAR_BITS) -> DataFrame:
    """docs without near copies, with all their columns: of each group that links connect, the row with the smallest id stays.

    Of rows that share that id and text one stays, that of the least hash of its columns. A null id counts as larger than all others; ids
    may be of any type with an order. Null and empty texts are copies of each other. An empty table stays empty. Columns of any
    type and name are carried along. Texts of any length are compared whole.
    """

    @F.pandas_udf("key binary, raw binary, least array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        def of(s: np.ndarray) -> tuple[bytes, bytes, np.ndarray]:
            return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), wide_fingerprint(s).tobytes(), least_keys(s)

        return pd.DataFrame([of(shingle_set(t)) for t in texts], columns=["key", "raw", "least"])  # no batch's sets are held together

    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    first = F.struct(_order(named(doc_id)).alias("doc"), F.xxhash64(F.coalesce(named(text), F.lit(""))).alias("t"))
    slim = store(docs.select(first.alias("first"), sketch(named(text).cast("binary")).alias("s")).select("first", "s.*"), "wide")
    own = slim.groupBy("key").agg(F.min("first").alias("first"), F.first("raw").alias("raw"), F.first("least").alias("least"))
    # numbered once and written, so that two sets never share a number
    own = store(own.select(F.monotonically_increasing_id().alias("id"), "raw", "least", "first"), "distinct")
    of = components(store(near_links(own, docs.select(first.alias("first"), named(text).alias("text")), bits), "near"))
    own = own.join(of.withColumnRenamed("node", "id"), "id", "left").select(F.coalesce("component", "id").alias("component"), "first")
    stay = own.groupBy("component").agg(F.min("first").alias("first")).select("first")
    others = F.to_json(F.struct(F.lit(0).alias("none"), *[named(c) for c in docs.columns if c != text]))
    rows = docs.select(first.alias("first"), F.struct(*map(named, docs.columns)).alias("_row"), F.xxhash64(others).alias("_h"))
    # rows of one id and text meet here, already dealt by the join's key
    return rows.join(stay, "first").groupBy("first").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
