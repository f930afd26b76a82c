"""SimHash, mixing, substrings, decontamination and tokens against brute force, with odd inputs."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspan.llm import components, decontam, hashing, mixing, simhash, substrings, tokens

ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (5, "Ünïcode 😀 text"), (5, "Ünïcode 😀 text"), (5, "another text"), (8, "a " * 5000)]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=0, n=120):
    rng, docs = random.Random(seed), []
    shared = " ".join(words(rng, 60))
    for k in range(n):
        t = " ".join(words(rng, rng.randint(1, 120)))
        if k % 5 == 0:
            t += " " + shared + " tail " + str(k)
        docs.append((10 + k, t))
    docs += [(1000 + k, docs[k][1]) for k in range(20)]  # copies
    for k in range(20):  # near copies
        w = docs[k][1].split()
        w[len(w) // 2] = "changed"
        docs.append((2000 + k, " ".join(w)))
    return docs


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(fps, bits=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("longest", [2048, 2])
def test_simhash(frame, longest):
    docs = ODD + corpus()
    got = sorted(simhash.classes(frame(docs), longest=longest).collect(), key=lambda r: (str(r["doc_id"]), r["fp"]))
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f - (1 << 64) if f >> 63 else f, least.get(r)) for (i, _), f, r in zip(docs, fps, roots, strict=True)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[1]))


def test_hub_links_connect_all_pairs(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base} | {base ^ sum(1 << b for b in rng.sample(range(32), rng.randint(1, 5))) for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    sig = simhash.SIGNATURES.index((0, 1, 2, 3))
    df = spark.createDataFrame([(sig, 0, f) for f in signed], "sig long, key long, fp long")
    got = components.components(simhash.hub_links(df)).collect()
    by = {r["node"]: r["component"] for r in got}
    roots = brute_components(fps)
    groups = {}
    for f, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k, v in by.items() if v == c) for c in set(by.values())}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(500, 500)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 160)) and got[500] == 500
    assert all(got[a] == got[b] for a, b in pairs)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("longest", [2048, 4])
def test_near_dedup(frame, longest, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.NEAR_BITS, longest))
    rng, docs = random.Random(4), []
    for k in range(30):
        docs.append((k, " ".join(words(rng, 200, 5000))))
    docs += [(100 + k, docs[k][1]) for k in range(10)]
    for k in range(10, 20):
        w = docs[k][1].split()
        w[100] = "changed"
        docs.append((200 + k, " ".join(w)))
    docs += [(None, None), (400, ""), (0, docs[0][1])]
    out = simhash.deduplicated(frame(docs))
    assert out.columns == frame(docs).columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30), 400]
    assert simhash.deduplicated(frame([])).collect() == []


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_dedup_at_the_threshold(frame):
    """Pairs a little over 0.8 lose a side, pairs a little under it do not, whichever way they were edited."""
    rng, docs, near = random.Random(5), [], {}

    def edited(w, kind, n):
        fresh = words(rng, n, 5000)
        if kind == "appended":
            return w + fresh
        if kind == "block":
            return w[:50] + fresh + w[50 + n :]
        w = list(w)
        for k, at in enumerate(rng.sample(range(len(w)), n)):
            w[at] = fresh[k]
        return w

    for kind, over, under in (("appended", 49, 60), ("block", 17, 28), ("scattered", 4, 7)):
        for k in range(60):
            w = words(rng, 200, 5000)
            n, base = (over, under)[k % 2], len(docs)
            other = edited(w, kind, n)
            docs += [(base, " ".join(w)), (base + 1, " ".join(other))]
            near[base + 1] = kind, jaccard(w, other) >= 0.8
    assert {kind: {v for q, v in near.values() if q == kind} for kind, _ in near.values()} == dict.fromkeys(("appended", "block", "scattered"), {True, False})
    stay = {r["doc_id"] for r in simhash.deduplicated(frame(docs)).select("doc_id").collect()}
    assert {k: k not in stay for k in near} == {k: v for k, (_, v) in near.items()} and all(k in stay for k in range(0, len(docs), 2))


def test_near_dedup_repeats(frame):
    """A line that is repeated often fills the counts of a fingerprint, but is a few shingles only."""
    rng = random.Random(6)
    docs = [(k, " ".join(["x"] * 4000 + words(rng, 60, 5000))) for k in range(6)]
    assert simhash.deduplicated(frame(docs)).count() == 6


def sql(query, docs):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d[0], d[1], d[2] if len(d) > 2 else "s") for d in docs])
    return sorted(map(str, c.execute(query).fetchall()))


def test_mixing_matches_sql(frame):
    rng = random.Random(7)
    docs = [(k, " ".join(words(rng, rng.randint(0, 40))) or None, rng.choice(["a", "b", "b", "b", "Z", None, "é"])) for k in range(300)] + [(3, "twice is twice", "a"), (None, "no id", "b"), (9999, None, "empty")]
    got = mixing.report(frame(docs)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == sql(mixing.ORACLE_SQL, docs)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    times = sum(r["taken"] // r["size"] for r in got if r["size"])
    out = mixing.mixed(frame(docs))
    assert out.columns == frame(docs).columns and out.where("size is not null").count() >= times


def test_mixing_reaches_targets(frame):
    rng = random.Random(8)
    docs = [(k, " ".join(words(rng, rng.randint(5, 15))), "hot" if k % 3 else f"s{k % 7}") for k in range(4000)]
    found = {}
    for r, s in ((r, r["target"]) for r in mixing.report(frame(docs)).collect()):
        found.setdefault((r["source_size"], s), []).append(r["taken"])
    assert all(abs(sum(t) - target) < max(20, 0.01 * target) * 3 for (_, target), t in found.items())


@pytest.mark.parametrize("shares", [(), (0.5,), (0.2, 0.4, 0.6, 0.8)])
def test_substrings(frame, shares):
    docs = [d for d in ODD if d[0] not in (None, 5)] + [(6, "Ünïcode 😀 text " * 9)] + corpus(3, 60) + [(9000, "a " * 5000)]
    got = substrings.report(frame(docs), shares=shares).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sql(substrings.ORACLE_SQL, docs)


def test_substrings_odd_ids(frame):
    long = " ".join(f"w{k}" for k in range(20))
    docs = [(None, long), (None, long), (5, long), (5, long), (5, "x y")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substrings.report(frame(docs)).collect())
    assert got == [("5", 2, 0), ("5", 20, 0), ("5", 20, 0), ("None", 20, 20), ("None", 20, 20)]
    assert substrings.report(frame([])).collect() == []


def test_stretches_agree_on_windows():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    a, s, first, count = substrings.stretches(h)
    assert (np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)]) == np.arange(488)).all()
    assert count.max() <= 8 and len(a) == len(s)


def test_substrings_hash_texts_end_to_end():
    """Texts hashed together give the stretches and windows of each by itself; thousands of short ones take a few steps, not some for each."""
    rng = random.Random(4)
    texts = [b"", b"  ", *(" ".join(words(rng, rng.randint(0, 60), 30)).encode() for _ in range(300)), b"x " * 500, "é😀\n".encode() * 40, b"", b"end"]
    texts += texts[2:40]
    bounds = np.cumsum([0, *map(len, texts)])
    starts, ends = hashing.places_within(np.frombuffer(b"".join(texts), np.uint8), bounds, hashing.NOT_SPACE)
    row = np.searchsorted(bounds, starts, "right") - 1
    h = hashing.word_hashes(b"".join(texts), starts, ends)
    alone = [hashing.word_hashes(t, *hashing.places(t, hashing.NOT_SPACE)) for t in texts]
    assert [h[row == k].tolist() for k in range(len(texts))] == [x.tolist() for x in alone]
    got, begin = [], np.searchsorted(row, np.arange(len(texts)))
    for a, s, first, count in zip(*substrings.stretches(h, text=row), strict=True):
        got.append((int(row[first]), int(a), int(s), int(first - begin[row[first]]), int(count)))
    assert got == [(k, *map(int, x)) for k, own in enumerate(alone) for x in zip(*substrings.stretches(own), strict=True)] and len(got) > 1000
    bits, made = substrings.count_bits(13), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.binary())], names=["d", "t", "text"])
    run = substrings._rows(lambda h, row, batch: made.append(len(h)) or substrings.stretches(h, text=row), bits)
    rows = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    at = [r["at"] if r["at"] >= 0 else -1 - r["at"] for r in rows]
    assert sorted((r["d"], x >> bits, x & (1 << bits) - 1) for r, x in zip(rows, at, strict=True)) == sorted((k, f, n) for k, _, _, f, n in got)
    least = {}
    for k, a, s, _, _ in got:
        least[a, s] = min(k, least.get((a, s), k))
    assert sum(r["at"] < 0 for r in rows) == sum(least[a, s] < k for k, a, s, _, _ in got) > 0
    assert len(made) == 1


def test_compacted_runs_have_a_file_a_bucket(frame, spark):
    """Not one for each task and bucket."""
    index, docs = substrings.SubstringIndex(spark), sorted(corpus(13, 40))
    for k in (0, 40):
        index.dedup(frame(docs[k : k + 40])).count()
    files = [re.search(r"_(\d{5})\.c\d+", f)[1] for f in spark.table(index.runs[0]).inputFiles()]
    assert len(files) == len(set(files)) <= index.buckets  # a file a bucket, not one for each task and bucket
    index.close()


@pytest.mark.parametrize("part", [5, 60, components.PART])
def test_components_by_parts(spark, part):
    """Paths, stars, loops and repeated links, contracted by one task or by many with rounds after them."""
    rng = random.Random(part)
    names = rng.sample(range(-(10**12), 10**12), 400)
    pairs = [(names[k], names[k + 1]) for k in range(90)] + [(names[100], names[k]) for k in range(101, 180)] + [(names[k], names[k]) for k in range(170, 200)]
    pairs += [tuple(rng.sample(names[200:], 2)) for _ in range(120)]
    pairs = rng.sample(pairs + pairs[:50], len(pairs) + 50)
    least = {x: x for p in pairs for x in p}
    while any(least[a] != least[b] for a, b in pairs):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), part=part).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(least.items())


def test_components_of_few_links_take_few_jobs(spark):
    """The driver has no rounds of shuffles to keep account of where a task can hold the links."""
    links = spark.range(2000).selectExpr("id a", "id div 2 b")
    spark.sparkContext.setJobGroup("few links", "few links")
    try:
        assert components.components(links).where("component = 0").count() == 2000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8


def test_common():
    rng = random.Random(0)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [row[j - 1] + 1 if x == b[j - 1] else 0 for j in range(1, len(b) + 1)] if False else _next(row, x, b)
        return row[-1]

    def _next(old, x, b):
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(old[j - 1] + 1 if x == y else max(old[j], new[-1]))
        return new

    for _ in range(50):
        a, b = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 20))], [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        assert decontam.common(a, b) == plain(a, b)


def test_decontamination(frame, spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, rng.randint(15, 50), 3000)) + ".") for k in range(30)] + [(99, None), (98, "")]
    docs, want = list(ODD), {}
    for k in range(200, 400):
        w = words(rng, rng.randint(50, 300), 3000)
        if k % 10 == 0:
            item = (k // 10) % 30
            at = rng.randrange(len(w))
            piece = items[item][1].rstrip(".").split()
            if k % 20 == 0:
                piece[3] = "another"  # a paraphrase
            w[at:at] = piece
            want[k] = str(item)
        docs.append((k, " ".join(w).upper() if k % 30 == 0 else " ".join(w)))
    df, bench = frame(docs), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontam.report(df, bench).where("contaminated").collect()}
    assert got == want
    out = decontam.clean(df, bench)
    assert out.columns == df.columns and out.count() == len(docs) - len(want)
    assert decontam.report(df, bench.where("false")).where("contaminated").count() == 0
    assert decontam.report(frame([]), bench).collect() == []


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 65_537):
        assert sorted(tokens.permute(np.arange(n), n).tolist()) == list(range(n))
    assert tokens.permute(np.arange(1000), 1000, 1).tolist() != tokens.permute(np.arange(1000), 1000, 2).tolist()


def test_tokens_round_trip(frame, tmp_path):
    with open(tokens.VOCABULARY, "rb") as f:
        coder = tokens.Encoder(f.read())
    odd = ["a  b", "a \n b", " lead", "trail ", "it's 'll x  ", "é  1 2\t3", "x \u3000y z"]
    docs = ODD + [(300 + k, t) for k, t in enumerate(odd)] + corpus(2, 40)
    df = tokens.materialised(frame(docs), length=16, per_shard=8).cache()
    rows = df.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    found = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["seq_no"])):
        if r["doc_id"] != 5:
            found.setdefault(r["doc_id"], []).extend(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist())
    for i, t in docs:
        if t and i != 5:
            assert found[i][-1] == tokens.END and coder.engine.decode(found[i][:-1]) == t
    assert not {1, 2} & found.keys()
    path = f"file://{tmp_path}/shards"
    written = tokens.write_shards(df, path).collect()
    assert sum(r["sequences"] for r in written) == len(rows) and sum(r["bytes"] for r in written) == 32 * len(rows)
    again = tokens.written(frame(docs), f"file://{tmp_path}/again", length=16, per_shard=8)
    assert again.columns == df.columns and sorted((r["slot"], bytes(r["tokens"])) for r in again.collect()) == sorted((r["slot"], bytes(r["tokens"])) for r in rows)
    at = {r["slot"]: r["tokens"] for r in rows}
    got = tokens.read_slots(path, 5, 20, 16, 8)
    assert [x.tobytes() for x in got] == [bytes(at[s]) for s in range(5, 25)]
    assert tokens.materialised(frame([])).collect() == []



def test_slots_do_not_depend_on_the_split(frame):
    """Against a plain second computation: documents in order of null last, id, then encoded; slots by the permutation."""
    with open(tokens.VOCABULARY, "rb") as f:
        coder = tokens.Encoder(f.read())
    docs = [d for d in ODD + corpus(4, 60) if d[0] not in (5,)]
    pieces = []
    for i, t in sorted((d for d in docs if d[1]), key=lambda d: (d[0] is None, d[0] or 0)):
        ids = coder.encode(t) + coder.end
        pieces += [(i, n, ids[at : at + 32]) for n, at in enumerate(range(0, len(ids), 32))]
    slots = tokens.permute(np.arange(len(pieces)), len(pieces)).tolist()
    want = sorted((s, i, n, p + coder.end * (16 - len(p) // 2)) for s, (i, n, p) in zip(slots, pieces, strict=True))
    for parts in (3, 7):
        got = tokens.materialised(frame(docs).repartition(parts), length=16, per_shard=8).collect()
        assert sorted((r["slot"], r["doc_id"], r["seq_no"], bytes(r["tokens"])) for r in got) == want


def test_paraphrases_are_found(frame, spark):
    """Of items whose words were replaced in part, all that still have COVER of their words are found, and no clean document is."""
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.randint(20, 60), 4000)) + ".") for k in range(40)]
    docs, want = [(1000 + k, " ".join(words(rng, 200, 4000))) for k in range(60)], set()
    for n, share in enumerate((0, 0.1, 0.2, 0.24)):
        for k, t in items:
            w = t.rstrip(".").split()
            for at in rng.sample(range(len(w)), int(share * len(w))):
                w[at] = f"other{rng.randrange(10**6)}"
            host = words(rng, 120, 4000)
            docs.append((5000 + 100 * n + k, " ".join(host[:50] + w + host[50:])))
            if decontam.common([x.encode() for x in t.rstrip(".").split()], [x.encode() for x in w]) >= decontam.COVER * len(w):
                want.add((5000 + 100 * n + k, str(k)))
    got = {(r["doc_id"], r["items"]) for r in decontam.report(frame(docs), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert len(got & want) >= 0.95 * len(want) and not any(i < 5000 for i, _ in got)


def test_items_ruled_out_by_a_text_are_in_none_of_its_passages():
    """What possible() leaves out changes no result, and the quick sums and counts equal plain ones."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(4, 150))))) for k in range(60)] + [(60, "")]
    texts = [" ".join(rng.choice(words[: 40 * (1 + k % 10)], int(rng.integers(1, 300)))) for k in range(40)]
    texts += [texts[k] + " " + " ".join(w for w in items[k][1].split() if rng.random() > 0.15) for k in range(40)] + ["", "?!"]
    weight = rng.standard_normal((decontam.BUCKETS, 16)).astype(np.float32)
    block = decontam.block_of(items, weight)
    found = [decontam.search(block, t.encode(), weight, 0.0) for t in texts]  # half of all passages are candidates
    block["needed"] = block["needed"] * 0
    assert found == [decontam.search(block, t.encode(), weight, 0.0) for t in texts]
    assert sum(map(len, found)) >= 30
    for t in texts:
        h = decontam._hashes(t.encode())
        if len(h):
            plain = np.add.reduceat(weight[decontam._bucket(h)], np.arange(0, len(h), decontam.STEP), axis=0)
            assert np.allclose(decontam._steps(decontam._bucket(h), weight), plain, atol=1e-4)
            assert all(decontam._held(own, h) == np.isin(own, h).sum() for own in block["hashes"] if len(own))
    empty = decontam.block_of([(1, "")], weight)
    assert decontam.search(empty, b"some words", weight) == []


def test_decontamination_in_blocks(frame, spark, monkeypatch):
    """Several blocks, text ids of items, and a report equal to a search for every item in every document by its longest common subsequence."""
    rng = random.Random(10)
    items = [(f"q{k}", " ".join(words(rng, 30, 2000)) + ".") for k in range(12)]
    docs = [(None, items[3][1]), (1, None), (2, "")]
    for k in range(40):
        w = words(rng, 150, 2000)
        if k % 4 == 0:
            w[60:60] = items[k % 12][1].rstrip(".").split()
        docs.append((10 + k, " ".join(w)))
    plain = lambda t: re.findall(rb"[a-z0-9]+", (t or "").lower().encode())
    want = sorted((str(i), ",".join(sorted(q for q, x in items if decontam.common(plain(x), plain(t)) >= decontam.COVER * len(plain(x))))) for i, t in docs)
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontam, "BLOCK", 100)
    assert decontam._items(bench, "item_id", "text")[1] > 2
    assert sorted((str(r["doc_id"]), r["items"]) for r in decontam.report(frame(docs), bench).collect()) == want
    assert decontam.clean(frame(docs), bench).count() == sum(not x for _, x in want)


@pytest.mark.parametrize("width", [6, 21, 50])
def test_substrings_of_other_widths(frame, width):
    docs = corpus(11, 30)
    got = sorted((r["doc_id"], r["n_removed"]) for r in substrings.deduplicated(frame(docs), shares=(0.2, 0.4, 0.6, 0.8), width=width, fanout=3).collect())
    seen, want = {}, []
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            seen[key] = min(i, seen.get(key, i))
    for i, t in docs:
        w = t.split()
        want.append((i, len({p for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] < i for p in range(k, k + width)})))
    assert got == sorted(want)


def test_substring_runs(frame, spark):
    """Runs are compacted into one, and a batch meets them without a shuffle of theirs."""
    index, docs = substrings.SubstringIndex(spark), corpus(12, 40)
    for k in range(0, len(docs), 40):
        index.dedup(frame(sorted(docs)[k : k + 40])).count()
    assert len(index.runs) == 1 and index.merged
    plan = index.history().groupBy("a", "s").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.clear_merged()
    assert index.history().count() > 0
    with pytest.raises(ValueError, match="words"):
        substrings.SubstringIndex(spark, width=5)
    with pytest.raises(ValueError, match="whole number"):
        index.dedup(frame(docs).withColumn("doc_id", F.col("doc_id").cast("string")))
    names = set(index.tables)
    assert {t.name for t in spark.catalog.listTables()} & names
    index.close()
    assert not {t.name for t in spark.catalog.listTables()} & names and not index.tables


def test_mixing_tells_rows_of_one_id_apart(frame):
    """Sources without ids still come near their targets, and columns of any type and name are carried along."""
    docs = [(None, f"word number {k} of a text", "a" if k % 2 else "b") for k in range(100)]
    got = mixing.report(frame(docs)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 6 for r in got)
    odd = frame(docs).withColumn("a.b", F.create_map(F.lit("k"), F.col("doc_id")))
    assert mixing.mixed(odd).columns == odd.columns and simhash.deduplicated(odd).columns == odd.columns and simhash.deduplicated(odd).count() > 1
    assert mixing.report(frame([])).collect() == []


def test_decomposition_holds_every_document(frame, spark):
    """Each document's passage lies in the directions found, also if it is one of hundreds and the only one of its kind."""
    rng = random.Random(12)
    usual = [" ".join(words(rng, 50, 4000)) for _ in range(10)]
    rare = [" ".join(words(rng, 50, 4000)) for _ in range(30)]
    hashes = decontam.hashed(frame([(k, usual[k % 10]) for k in range(600)] + [(1000 + k, t) for k, t in enumerate(rare)]))
    seen, n, cut = decontam.frequencies(hashes)
    assert n == cut == 630 and decontam.frequencies(decontam.hashed(frame([(1, "a b " * 40), (2, None), (3, "")])))[1:] == (3, 2)
    idf = (np.log((1 + n) / (1 + seen)) ** 2).astype(np.float32)
    items = decontam.hashed(spark.createDataFrame([(" ".join(words(rng, 30, 4000)),)], "text string"))
    found = decontam.decompose(hashes, items, seen, cut, idf)
    found[:, : decontam.SHARED] /= decontam.DAMPED
    for t in usual + rare:
        f, tf = np.unique(decontam._bucket(decontam._hashes(t.encode())), return_counts=True)
        v = tf * idf[f] / np.linalg.norm(tf * idf[f])
        assert np.linalg.norm(v @ found[f]) > 0.99


def test_products_with_passages():
    """Sums over places, without a passage's distinct words, give A'(A x)."""
    rng = np.random.default_rng(5)
    idf = np.append(rng.random(decontam.BUCKETS), 0).astype(np.float32)
    texts = [rng.choice(rng.integers(0, decontam.BUCKETS, 20), n).astype("<u2") for n in (0, 1, 64, 65, 500, 9000)]
    x = np.vstack([rng.standard_normal((decontam.BUCKETS, 8)), np.zeros((1, 8))]).astype(np.float32)
    total, want = np.zeros_like(x), np.zeros(x.shape)
    for passages, weights in decontam._cut([t.tobytes() for t in texts], np.arange(1.0, 7)):
        decontam.gram_times(passages, (weights / np.maximum(decontam._squares(passages, idf), 1e-20)).astype(np.float32), idf[:, None] * x, total)
    for t, weight in zip(texts, np.arange(1.0, 7), strict=True):
        for k in range(0, len(t), 64):
            f, tf = np.unique(t[k : k + 64], return_counts=True)
            v = tf * idf[f] / np.linalg.norm(tf * idf[f])
            want[f] += weight * np.outer(v, v @ x[f])
    assert np.allclose((idf[:, None] * total)[:-1], want[:-1], rtol=1e-3, atol=1e-3)
