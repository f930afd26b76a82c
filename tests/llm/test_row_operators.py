"""PII, licenses, URLs, quality and toxicity against brute force, with odd inputs."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import licenses, pii, quality, toxicity, urls

ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (5, "Ünïcode 😀 text"), (5, "Ünïcode 😀 text"), (7, "x" * 200_000), (8, "a " * 50_000)]


def rows_of(df, by="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def brute_pii(t):
    t = t or ""
    luhn = lambda d: sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), list(kinds).index(k), m.end(), k) for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


PII = [
    "mail a.b@c.de, @x.y a@b.c@d.ee 1.2.3.4.5.6.7.8 999.1.1.1.5 +49 (30) 1234567 x+1 2", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559x", "a@b@c.d..e@f.g-h.i +1-800-555-0199.", "IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789",
    "order 123-45-6789", "١٢٣.1.2.3 1.2.3.١", "e" * 3000 + "@" + "1" * 5000,
]


def test_pii_base_spans(frame):
    docs = ODD + [(100 + k, t) for k, t in enumerate(PII)]
    rng = random.Random(3)
    docs += [(1000 + k, "".join(rng.choice("ab1 9.@+-()%4") for _ in range(200))) for k in range(200)]
    got = pii.report(frame(docs)).collect()
    assert len(got) == len(docs)
    want = sorted((str(i), hashlib.sha256(",".join(brute_pii(t)).encode()).hexdigest()) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want


def test_pii_method_kinds():
    kinds = lambda t: [x[0] for x in pii.scan(t)]
    assert "iban" in kinds("my iban DE89 3704 0044 0532 0130 00") and "iban" not in kinds("iban DE89 3704 0044 0532 0130 01")
    assert "ssn" in kinds("his ssn 123-45-6789") and "ssn" not in kinds("order 123-45-6789")


def test_pii_redact(frame):
    assert [r["text"] for r in pii.redact(frame([(1, "to a@b.cc now"), (2, None)])).orderBy("doc_id").collect()] == ["to [email] now", None]


def test_licenses(frame):
    texts = ["Licensed under CC BY-NC 4.0.", "CC-BY cc by all rights, reserved; ALL RIGHTS RESERVED", "the gnu general public license", "cc", "by cc", "Permission is hereby granted, free of charge, to any other obtaining a copy of this software and associated documentation files (the"]
    docs = ODD + [(100 + k, t) for k, t in enumerate(texts)] + [(100, "all rights reserved")]
    want = []
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want.append((str(i), len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.report(frame(docs)).collect()
    assert sorted(str((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == sorted(map(str, want))
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (5, 100)}
    assert by[105]["labels"] == "mit" and 0.8 <= by[105]["score"] < 1 and by[1]["score"] == 0


def test_licenses_with_insertions(frame):
    """All words of a template with insertions of three words: the span is whole, as the words under all merged diagonals are aligned."""
    words, rng = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split(), random.Random(2)
    docs, plain = [], {}
    for k in range(40):
        w = list(words)
        for at in sorted(rng.sample(range(3, len(words) - 3, 3), k % 4 + 1), reverse=True):
            w[at:at] = [f"x{k}a", f"y{k}b", f"z{k}c"]
        before = [f"p{j}" for j in range(k)]
        docs.append((k, " ".join([*before, *w, "tail", "words"])))
        plain[k] = (k, k + len(w) - 1, len(words))
    got = {r["doc_id"]: r for r in licenses.spans(frame(docs)).where("template = 4").collect()}
    for k, (first, last, _) in plain.items():
        assert (got[k]["first"], got[k]["last"], got[k]["score"]) == (first, last, 1.0), (k, got[k])


def test_licenses_empty(frame):
    assert licenses.report(frame([])).collect() == []


def test_urls(spark):
    rows = [
        (1, "https://A.Example.com/en/7?x", "<p>tree house</p>"), (2, "http://treehouse.example.com/en/8#t", "<p>tree house tree house</p>"), (3, "http://b.net/de/9", None), (4, "x://example.net/de/8/1", ""), (5, "http://org", ""), (6, "ftp://user@q.org:80/es/a?b#c", ""),
        (7, None, None), (8, "no scheme", ""), (None, "http://spam-farm.info/a", "<p>spam</p>"), (9, "http://notcom/en/", ""), (10, "http://x.com?/en/", ""), (11, "http://" + "a" * 3000 + ".de/" + "b" * 50_000, ""),
    ]
    got = {r["page_id"]: r for r in urls.report(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert len(got) == len(rows)
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("com/en/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("net/de/", "allow")
    assert (got[4]["rule"], got[4]["verdict"]) == ("example.net/de/8", "block")
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("org", "", None)
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("user@q.org:80", "/es/a", None)
    assert (got[7]["host"], got[8]["host"], got[7]["path"]) == ("", "", "")
    assert got[None]["label"] and got[None]["rule"] is None and got[9]["rule"] is None and (got[10]["host"], got[10]["path"]) == ("x.com", "")


def test_urls_bayes_against_plain_counts(spark):
    """Labels, features and log odds computed anew; the model is not the seed list."""
    rng, rows = random.Random(4), []
    for k in range(120):
        bad, seeded = k % 3 == 0, k % 9 == 0
        name = ["casino"] * seeded + [rng.choice(["lucky", "spin"] if bad else ["garden", "tree"]) for _ in range(2)]
        rows.append((k, f"http://{'-'.join(name)}.{rng.choice(['com', 'org', 'net'])}{rng.choice(['', ':80'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice(['a', 'b', '12'])}/{rng.choice(['x', '345'])}", ""))
    rows += [(500, None, None), (501, "http://spam.com/en/x", ""), (502, "http://org", "")] * 2
    rule = {"com/en/": "block", "net/de/": "allow", "org/es/": "block"}
    split, pages = lambda x: re.findall("[a-z0-9]+", x), []
    plain = lambda w: f"#{len(w)}" if w.isdigit() else w
    for i, u, _ in rows:
        host, path = (re.match(r"http://([^/]*)(.*)", u).groups() if u else ("", ""))
        hit = next((r for r in rule if (host + "/").endswith(r.split("/")[0] + "/") and path.startswith("/" + r.split("/")[1] + "/")), None)
        names, way = split(re.sub(":[0-9]*$", "", host)), split(path)
        label = rule[hit] == "block" if hit else True if any(w in urls.SEEDS for w in names[:-1]) else None
        place = (names or [""])[-1] + "/" + plain((way or [""])[0])
        feats = [("h", plain(w)) for w in names[:-1]] + [("place", place), ("start", place + "/" + (way[1:] or [""])[0][:1])] + [("p", plain(w)) for w in way[1:]]
        pages.append((i, feats, label))
    vocabulary = {w for _, t, _ in pages for w in t}
    mass = lambda c, y: float(bool(y) == c) if y is not None else urls.UNLABELLED * (not c)
    count = {c: {w: sum(t.count(w) * mass(c, y) for _, t, y in pages) for w in vocabulary} for c in (True, False)}
    prior = np.log((sum(mass(True, y) for *_, y in pages) + 1) / (sum(mass(False, y) for *_, y in pages) + 1))
    weight = lambda w: np.log((count[True][w] + 1) / (sum(count[True].values()) + len(vocabulary) + 1)) - np.log((count[False][w] + 1) / (sum(count[False].values()) + len(vocabulary) + 1))
    want = sorted((i, str(y), float(prior + sum(map(weight, f)))) for i, f, y in pages)
    got = urls.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    close = sorted((r["page_id"], str(r["label"]), r["log_odds"]) for r in got)
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 for a, b in zip(close, want, strict=True))
    assert any(r["label"] is None and r["verdict"] == "block" for r in got)


def test_urls_held_out(spark):
    """Hosts that the model never saw are told by the words that go with blocked ones."""
    rng, rows = random.Random(5), []
    for k in range(900):
        bad = k % 3 == 0
        name = ["casino"] * bad + [rng.choice(["lucky", "spin", "jack", "bonus"] if bad else ["garden", "tree", "house", "river"]) for _ in range(3)]
        rows.append((k, f"http://{'-'.join(name)}{k}.info/fr/{rng.randrange(9)}", ""))
    rule = F.crc32("host") % 5 != 0
    got = urls.report(spark.createDataFrame(rows, "page_id long, url string, html string"), fit_on=rule).where(~rule).collect()
    assert len(got) > 100 and np.mean([(r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got]) > 0.95
    assert urls.report(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize("key, least", [("page_id", 0.95), ("host", 0.9)])
def test_urls_agree_with_held_out_rules_and_seeds(spark, key, least):
    """On pages, or whole hosts, that were held out from training the model itself agrees with rules and seeds; no suffix and no language decides."""
    rule = F.crc32(F.col(key).cast("string")) % 5 != 0
    got = urls.report(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), fit_on=rule).where(~rule).collect()
    told = [r for r in got if r["label"] is not None]
    right = lambda some: np.mean([(r["log_odds"] > 0) == r["label"] for r in some])
    assert len(told) > 80 and right(told) >= least
    for some in ([r for r in told if r["label"]], [r for r in told if not r["label"]], [r for r in told if r["rule"] is None] if key == "page_id" else []):
        assert not some or right(some) >= 0.9
    every = urls.report(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("label is null").collect()
    for of in (lambda r: r["host"].rsplit(".", 1)[-1], lambda r: r["path"].split("/")[1]):
        share = {v: np.mean([r["verdict"] == "block" for r in every if of(r) == v]) for v in {of(r) for r in every}}
        assert max(share.values()) < 0.5, share


def test_viterbi():
    known = {(0, 4): 10, (4, 5): 10, (0, 2): 1}
    assert urls.split("treehouse", known, 100) == ["tree", "house"]
    assert urls.split("zzz", {}, 100) == ["zzz"] and urls.split("", {}, 100) == []


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    cover = {j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts():
    rng = random.Random(1)
    texts = ["", "a b c d e a b c d e", "x\nx\n x\n\n\nx", "é 😀 \u2003 \x85 \x1c b", *(" ".join(rng.choice("abc") + rng.choice(["", "\n", "#"]) for _ in range(60)) for _ in range(40))]
    for t in texts:
        assert tuple(quality.statistics(t)[0]) == brute_quality(t), t


def test_quality_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 2))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 0]) + 0.2 * x[:, 1] < 0.7).astype(float)
    f = quality.fit(x, y, trees=30, signs=(-1, 0))
    line = np.stack([np.linspace(0, 1, 400), np.full(400, 0.5)], axis=1)
    assert (np.diff(f.score(line)) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_quality_trees_are_fitted_on_all_labelled_rows(spark, labels):
    """More labelled rows than the 20,000 that a fit once ended at; the forest is the one of a plain fit on every row, however rows are dealt."""
    rng, n = np.random.default_rng(5), 21_000
    words = np.array(["aa", "Bbb", "c9!", "dddd", "$e", "f.\n"])
    texts = [" ".join(words[rng.integers(0, 2 + k % 5, 1 + k % 23)]) for k in range(n)]
    y = [int(("$" not in t) != (k % 7 == 0)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = quality.train(docs.repartition(5), labels([(k, v, 0) for k, v in enumerate(y)]), trees=4)
    want = quality.fit(np.array([quality.statistics(t)[1] for t in texts]), np.array(y), trees=4, signs=tuple(quality.MONOTONE.get(f, 0) for f in quality.FEATURES))
    for name in ("bias", "feature", "threshold", "value"):
        assert np.array_equal(getattr(forest, name), getattr(want, name)), name


def test_quality_report(frame, labels):
    good = [(k, f"line number {k} has ten different words which say some thing {k}") for k in range(40)]
    bad = [(100 + k, "### *** $$$ " * 4 + f"%%% a {k} b c d e f g &&& | | |") for k in range(40)]
    docs = frame(ODD + good + bad)
    forest = quality.train(docs, labels([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0)]))
    got = quality.judge(docs, forest).collect()
    assert len(got) == len(ODD) + 80
    assert all(r["kept"] == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] not in (1, 2, 3, 5, 7, 8) or r["doc_id"] in range(10, 40))
    assert not any(r["kept"] for r in got if r["base_failed"])
    kept = quality.keep(docs, forest)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(docs, quality.train(docs, labels([]))).where("kept and base_failed").count() == 0


def test_toxicity(frame, labels):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 7)))
    docs, marks = list(ODD), []
    for k in range(1000, 1400):
        toxic = k % 3 == 0
        docs.append((k, " ".join([word() for _ in range(40)] + (["wretchbag"] if toxic else []))))
        marks.append((k, 1, int(toxic)))
    df, marked = frame(docs), labels([*marks, (1, 1, 1), (None, 1, 1), (2, 1, None)])
    got = toxicity.scored(df, toxicity.train(df, marked, keep=lambda i: ~toxicity.held_out(i))).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 1000]
    assert len(got) == len(docs) and len(held) > 40
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] < 1e-9 for r in toxicity.scored(df, toxicity.train(df, labels([]))).collect())


def test_toxicity_against_a_plain_fit(frame, labels):
    """Counts by dictionary, ratios from the formula, and plain gradient steps on a dense matrix, for texts in any order."""
    rng = random.Random(4)
    kind, foul = "the quiet river ran over stones and under bridges".split(), "vile wretch rot scum".split()
    docs = [(k, " ".join(rng.choices(kind, k=8) + (rng.choices(foul, k=3) if k % 3 == 0 else []))) for k in range(90)] + [(90, None), (91, ""), (92, "a\u00e9 b"), (93, "vile river"), (93, "vile river")]
    truth = {i: int(i % 3 == 0) for i, _ in docs}
    own = frame(docs).repartition(3)
    model = toxicity.train(own, labels([(i, 0, y) for i, y in truth.items()]))
    found = [(i, t or "", set(toxicity.buckets(t).tolist())) for i, t in docs]
    n, toxic = len(found), sum(truth[i] for i, _, _ in found)
    counts = {}
    for i, _, b in found:
        for x in b:
            both = counts.setdefault(x, [0, 0])
            both[truth[i]] += 1
    sure = {}
    for x, (no, yes) in counts.items():
        ratio = math.log((yes + 1) / (toxic + 2)) - math.log((no + 1) / (n - toxic + 2))
        if no + yes >= 3 and abs(ratio) / math.sqrt(1 / (yes + 1) + 1 / (no + 1)) > 1.5:
            sure[x] = ratio
    assert len(sure) < toxicity.SELECT and set(np.flatnonzero(model.weight)) <= set(sure)
    names = sorted(sure)
    x = np.array([[sure[c] * (c in b) for c in names] for _, _, b in found])
    y, w, c = np.array([truth[i] for i, _, _ in found]), np.zeros(len(names)), 0.0
    rate = 1 / (0.25 * np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2 / n + 1e-3)
    for _ in range(20000):
        error = 1 / (1 + np.exp(-(x @ w + c))) - y
        w, c = w - rate * (x.T @ error / n + 1e-3 * w), c - rate * error.mean()
    want = sorted((i, p) for (i, _, _), p in zip(found, 1 / (1 + np.exp(-(x @ w + c))), strict=True))
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.scored(own, model).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [p for _, p in got] == pytest.approx([p for _, p in want], abs=0.02)
