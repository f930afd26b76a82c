"""Packing against the public tokenizer, brute-force knapsacks, and bounds on padding, with odd inputs."""

import itertools
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspan.llm import packing
from tallyspan.llm.tokens import Encoder

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 1]


def checked(pieces, texts, public, length=2048):
    """Every id once, sequences gapless and not too long; the number of padding ids."""
    want = sorted((str(i), ids) for i, ids in ((i, public(t)) for i, t in texts))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0 for r in pieces)
    found = {}
    for r in pieces:
        found.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    got = []
    for (i, n), parts in found.items():
        parts.sort()
        copies = len([p for p in parts if p[0] == 0])
        if copies == 1:
            assert [s for s, _ in parts] == list(itertools.accumulate([len(p) for _, p in parts[:-1]], initial=0))
            got.append((i, sum((p for _, p in parts), [])))
            assert len(got[-1][1]) == n
        else:  # rows alike in id and size: their ids together
            got.append((i, sorted(sum((p for _, p in parts), []))))
    one = {}
    for i, ids in want:
        one.setdefault((i, len(ids)), []).append(ids)
    assert sorted(got) == sorted((i, v[0] if len(v) == 1 else sorted(sum(v, []))) for (i, _), v in one.items())
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(range(len(by)))
    padding = 0
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([n for _, n in parts[:-1]], initial=0))
        used = sum(n for _, n in parts)
        assert used <= length
        padding += length - used
    return padding, len(by)


def test_whole_table(spark, public):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding, n = checked(packing.packed(docs.repartition(5)).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], public)
    assert padding < 0.01 * n * 2048


def test_odd_rows(frame, public):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c"), (None, None), (5, "Ünïcode 😀 text"), (5, "Ünïcode 😀 text"), (5, "another"), (8, "word " * 20000), (9, "<|endoftext|> x")] + [(k, "") for k in range(100, 400)] + [(k, "the same words " * 20) for k in range(500, 560)]
    pieces = packing.packed(frame(rows)).collect()
    padding, n = checked(pieces, rows, public)
    assert padding < 2048 + 0.02 * n * 2048
    assert packing.packed(frame([])).collect() == []
    assert packing.report(frame([])).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_short_sequences_and_hot_lengths(frame, public):
    rows = [(k, "x y z" * (k % 7)) for k in range(300)] + [(1000 + k, " q" * 40) for k in range(500)]
    padding, n = checked(packing.packed(frame(rows), length=63).collect(), rows, public, 63)
    assert padding < 64 + 0.02 * n * 64
    with pytest.raises(ValueError, match="positive"):
        packing.packed(frame(rows), length=0)


def test_does_not_depend_on_partitions(frame):
    rows = [(k, "some words of text " * (k % 90)) for k in range(400)]
    a, b = (sorted((r["doc_id"], r["start"], r["length"], r["offset"]) for r in packing.report(frame(rows).repartition(p)).collect()) for p in (2, 7))
    assert a == b


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_public_tokenizers(public, text):
    with open(packing.VOCABULARY, "rb") as file:
        coder = test_ids_are_the_public_tokenizers.__dict__.setdefault("coder", None) or Encoder(file.read(), 1)
    test_ids_are_the_public_tokenizers.coder = coder
    assert np.frombuffer(coder.encode(text) + coder.end, "<u2").tolist() == public(text)


@given(st.lists(st.integers(1, 12), min_size=1, max_size=4, unique=True), st.lists(st.floats(0, 5), min_size=4, max_size=4))
def test_knapsack(sizes, prices):
    sizes, prices = np.array(sorted(sizes)), np.array(prices[: len(sizes)])
    value, counts = packing.knapsack(prices, sizes, 20)
    best = max(prices @ c for c in itertools.product(*(range(20 // s + 1) for s in sizes)) if sizes @ c <= 20)
    assert abs(value - best) < 1e-9 and sizes @ counts <= 20 and abs(prices @ counts - value) < 1e-9


def test_linear_program_reaches_its_optimum():
    """Known optimum: items of 500 to 719 go three to a sequence and none four, so a third of them is needed; a dual solution proves it."""
    rng = np.random.default_rng(0)
    demand = np.bincount(rng.integers(520, 680, 5000) // 4)
    sizes = np.flatnonzero(demand)
    rows, x, bound, _ = packing.relaxed(demand[sizes].astype(float), sizes, 512)
    assert np.allclose(x @ rows, demand[sizes], atol=1e-6) and (rows @ sizes <= 512).all() and (x >= 0).all()
    assert x.sum() <= bound * 1.0002 + 1 and bound <= x.sum() + 1e-2
    _, _, _, priced = packing.relaxed(np.array([97.0, 610, 395, 211]), np.array([14, 31, 36, 45]), 100, 1e-9)  # the textbook's widths
    rows, x, _, _ = packing.relaxed(np.array([211.0, 395, 610, 97]), np.array([14, 31, 36, 45]), 100, 1e-9)
    assert priced and abs(x.sum() - 452.25) < 0.6


@pytest.mark.parametrize("low, high", [(1, 2048), (700, 1400), (500, 720), (1500, 1501), (1025, 2048), (1, 3)])
def test_plan_and_places(low, high):
    """Padding stays small whatever the lengths, no pattern asks for items that are not there, and every item has one place."""
    rng = np.random.default_rng(low)
    histogram = np.bincount(rng.integers(low, high, 6000), minlength=2048)
    found = packing.plan(histogram)
    places = packing.Places(histogram, found)
    size = np.repeat(np.arange(2048), histogram)
    sequence, pour = places.of(np.arange(len(size)), size)
    used = np.bincount(sequence[sequence >= 0], size[sequence >= 0], minlength=places.whole)
    assert len(used) == places.whole and used.max(initial=0) <= 2048
    asked = found.copies @ found.rows
    assert (np.bincount(found.classes[size], minlength=len(asked)) >= asked).all() and asked.sum() == (sequence >= 0).sum()
    out = sequence < 0
    at = np.argsort(pour[out], kind="stable")
    assert (pour[out][at] == np.concatenate([[0], size[out][at].cumsum()[:-1]])[: out.sum()]).all()
    assert places.sequences * 2048 - size.sum() <= 2048 + 0.03 * size.sum()


def test_nothing_to_plan():
    places = packing.Places(np.zeros(2048, np.int64), packing.plan(np.zeros(2048, np.int64)))
    assert places.sequences == 0
    assert os.path.exists(packing.VOCABULARY)
