"""The pipeline's stages, each against a plain computation over its own input; models of the quality stage aside, which test_row_operators has."""

import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallyspan.llm import mixing, quality, tokens


def tables(spark, folder, docs, labels=(), items=()):
    full = [(i, t, "en", s, len(t or "")) for i, t, s in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def shingles(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def survivors(docs):
    """The least id of each class of texts linked at 0.8 or more."""
    sets, boss = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            boss[high] = low
    return {i for i in sets if top(i) == i}


def made():
    rng = random.Random(12)
    vocabulary = [f"w{rng.randrange(10**6):06d}" for _ in range(3000)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = [(k, some(rng.randint(30, 90)), "abc"[min(2, k % 5)]) for k in range(60)]
    items = [(k, some(30)) for k in range(4)]
    docs += [(100 + k, docs[k][1] + " more", "a") for k in range(6)] + [(110 + k, docs[10 + k][1], "b") for k in range(3)]
    docs += [(120 + k, f"{some(20)} {items[k][1]} {some(20)}", "c") for k in range(3)]
    docs += [(130, "too short", "a"), (131, None, "a"), (132, "", None), (133, "five words again and again " * 30, "b"), (134, some(6000), None), (135, some(12), None)]
    return docs, items


def ran(spark, folder, monkeypatch):
    """(what run() stores after each stage but the last, its rows)."""
    kept, store = [], corpus_pipeline.store
    monkeypatch.setattr(corpus_pipeline, "store", lambda df, name: kept.append(store(df, name)) or kept[-1])
    rows = corpus_pipeline.run(spark, folder).collect()
    return kept, rows


def test_stages_against_plain_computations(spark, tmp_path, monkeypatch):
    docs, items = made()
    folder = tables(spark, tmp_path / "t", docs, items=items)
    (good, unique, clean, mix), rows = ran(spark, folder, monkeypatch)
    of = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in (good, unique, clean, mix))

    def sound(t):
        w = (t or "").split()
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    # without labels there are no trees, and the base rule decides alone
    assert sorted(of(good)) == sorted((i, t) for i, t, _ in docs if sound(t))
    assert {i for i, _ in of(unique)} == survivors(of(good)) and unique.count() == len(survivors(of(good)))
    texts = [t for _, t in items]
    assert sorted(of(clean)) == sorted((i, t) for i, t in of(unique) if not any(x in t for x in texts))
    assert {120, 121, 122} <= {i for i, _ in of(unique)}

    c = duckdb.connect()
    c.register("documents", clean.toArrow())
    names = [d[0] for d in c.execute(mixing.ORACLE_SQL).description]
    want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in (dict(zip(names, x, strict=True)) for x in c.fetchall()) if r["taken"]})
    assert Counter(i for i, _ in of(mix)) == want

    with open(tokens.VOCABULARY, "rb") as f:
        coder = tokens.Encoder(f.read())
    kind, pieces = f"<u{coder.width}", []
    for i, t in sorted(of(mix)):
        ids = np.frombuffer(coder.encode(t) + coder.end, kind).tolist()
        pieces += [(i, tuple(ids[at : at + tokens.LENGTH])) for at in range(0, len(ids), tokens.LENGTH)]
    got = [(r["doc_id"], tuple(np.frombuffer(r["tokens"], kind)[: r["n_tokens"]].tolist())) for r in rows]
    assert sorted(got) == sorted(pieces) and sorted(r["slot"] for r in rows) == list(range(len(pieces)))


def test_quality_stage_keeps_what_the_query_keeps(spark, tmp_path):
    docs, _ = made()
    labels = [(i, int((t or "").count(" ") > 50), 0) for i, t, _ in docs]
    folder = tables(spark, tmp_path / "t", docs, labels)
    own = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, own, folder).collect()}
    judged = quality.judge(own, quality.train(own, spark.read.parquet(f"{folder}/labels.parquet"))).collect()
    assert kept == {r["doc_id"] for r in judged if r["kept"]} and 0 < len(kept) < len(docs)


@pytest.mark.parametrize("docs", [[], [(1, None, None), (1, None, None), (None, "", "a")]])
def test_nothing_to_keep(spark, tmp_path, monkeypatch, docs):
    """Empty tables, and tables of null and empty texts, give no rows."""
    kept, rows = ran(spark, tables(spark, tmp_path / "t", docs), monkeypatch)
    assert rows == [] and [df.count() for df in kept] == [0] * 4


def test_decontamination_stage_fits_on_all_documents(spark, tmp_path, monkeypatch):
    """More documents than the 300 that the decomposition once took: every one's words reach it."""
    from tallyspan.llm import decontam

    seen, fit = [], decontam.decompose
    monkeypatch.setattr(decontam, "decompose", lambda words, *rest: (seen.append(words.count()), fit(words, *rest))[1])
    sf = tables(spark, tmp_path, [(k, f"text number {k} of many others", "a") for k in range(400)], items=[(1, "an item of some words that nobody repeats.")])
    kept = corpus_pipeline.decontamination(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert kept.count() == 400 and seen == [400]
