"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the positions at which the templates have it. A
hit votes for the diagonal (text position minus template position). Votes are summed by text, template and
diagonal; neighbouring diagonals, which insertions and deletions set apart, are merged; and the words under
all of them together are aligned with the template's to verify the span. The join's hits carry the text's words along
the template, so no text is shuffled: windows of neighbouring diagonals overlap, and are put together again.

Base templates are phrases, reported wherever all their words stand in a row. The other templates are sentences of well-known
licenses; they count from COVER of their words in order, short ones in full. Templates are a fixed list of at most some thousand
k-grams, which is broadcast.

Words are runs of a-z, 0-9 and anything beyond ASCII, after lower-casing A-Z. Null and empty texts have none; an empty table gives no rows. Texts of
any length are scanned whole. Columns other than the id and the text are not looked at.
Rows are told apart by id and text, so rows that share an id but not a text keep their own results, and
repeated rows repeat theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words that a span must have in order.
COVER = 0.8
#: Templates of at most so many words must stand in full: one word tells such licenses apart.
FULL = 8
#: Diagonals this far apart are one place.
NEAR = 3

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Sentences by which well-known licenses are told, as published with them.
SENTENCES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool

    @property
    def k(self) -> int:
        """Short phrases vote by word pairs, longer templates by triples."""
        return min(len(self.words), 3)


TEMPLATES = tuple(Template(tuple(text.split()), label, base) for some, base in ((BASE, True), (SENTENCES, False)) for text, label in some)


def words_of(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def in_order(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """(length, first, last) of the longest common subsequence of a template and words; places in words, last inclusive."""
    best = [(0, -1, -1)] * (len(words) + 1)
    for t in template:
        diagonal = best[0]
        for j, w in enumerate(words, 1):
            above = best[j]
            if t == w:
                n, first, _ = diagonal
                here = (n + 1, first if n else j - 1, j - 1)
                best[j] = here if here[0] > max(above[0], best[j - 1][0]) else max(above, best[j - 1], key=lambda x: x[0])
            else:
                best[j] = above if above[0] >= best[j - 1][0] else best[j - 1]
            diagonal = above
    return best[-1]


def _template_grams(spark, templates) -> DataFrame:
    rows = [(number, k, t.k, list(t.words[k : k + t.k]), len(t.words)) for number, t in enumerate(templates) for k in range(len(t.words) - t.k + 1)]
    df = spark.createDataFrame(rows, "template int, t_pos int, k int, gram array<string>, t_len int")
    pair, triple = F.xxhash64(F.col("gram")[0], F.col("gram")[1]), F.xxhash64(F.col("gram")[0], F.col("gram")[1], F.get("gram", F.lit(2)))
    return df.select(F.when(F.col("k") == 2, pair).otherwise(triple).alias("hash"), "template", "t_pos", "t_len")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, cover: float = COVER) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, base, first and last word (from 0), score (share of the template's words)."""
    if any(len(t.words) < 2 for t in templates):
        raise ValueError("a template needs two words or more")
    grams = _template_grams(docs.sparkSession, templates)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words_of(F.col(text)).alias("w"))
    at = rows.select("doc_id", "text_hash", "w", F.posexplode("w").alias("p", "first"))
    second, third = F.get("w", F.col("p") + 1), F.get("w", F.col("p") + 2)
    hashes = F.array(F.xxhash64("first", second), F.when(third.isNotNull(), F.xxhash64("first", second, third)))
    openers = sorted({t.words[k] for t in templates for k in range(len(t.words) - t.k + 1)})  # only a k-gram that begins with one of these can be in a template
    at = at.where(F.col("first").isin(openers) & second.isNotNull()).select("doc_id", "text_hash", "w", "p", F.explode(hashes).alias("hash"))
    hits = at.join(F.broadcast(grams), "hash")
    start = F.col("p") - F.col("t_pos")
    low = F.greatest(start - NEAR, F.lit(0))
    hits = hits.select("doc_id", "text_hash", "template", start.alias("diagonal"), "t_pos", low.cast("int").alias("low"), F.slice("w", low.cast("int") + 1, F.col("t_len") + 2 * NEAR).alias("words"))
    votes = hits.groupBy("doc_id", "text_hash", "template", "diagonal", "low").agg(F.count_distinct("t_pos").alias("votes"), F.first("words").alias("words"))
    places = votes.groupBy("doc_id", "text_hash", "template").agg(F.array_sort(F.collect_list(F.struct("diagonal", "low", "votes", "words"))).alias("d"))

    @F.pandas_udf("array<struct<first:long,last:long,score:double>>")
    def verify(template: pd.Series, diagonals: pd.Series) -> pd.Series:
        out = []
        for number, found in zip(template, diagonals, strict=True):
            t, spans_ = templates[number], []
            if t.base:  # every place where the words stand in a row
                for d in found:
                    begin = int(d["diagonal"]) - int(d["low"])
                    if d["diagonal"] >= 0 and tuple(d["words"][begin : begin + len(t.words)]) == t.words:
                        spans_.append((int(d["diagonal"]), int(d["diagonal"]) + len(t.words) - 1, 1.0))
            else:
                merged: list[list] = []
                for d in found:
                    if merged and d["diagonal"] - merged[-1][-1]["diagonal"] <= NEAR:
                        merged[-1].append(d)
                    else:
                        merged.append([d])
                for some in merged:
                    begin, words = int(some[0]["low"]), []
                    for d in some:  # each window goes on where the one before ended, or earlier
                        words += list(d["words"][begin + len(words) - int(d["low"]) :])
                    n, first, last = in_order(list(t.words), words)
                    if n >= (cover if len(t.words) > FULL else 1) * len(t.words):
                        spans_.append((first + begin, last + begin, n / len(t.words)))
            out.append([{"first": f, "last": e, "score": s} for f, e, s in spans_])
        return pd.Series(out, dtype=object)

    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    base = F.element_at(F.array(*[F.lit(t.base) for t in templates]), F.col("template") + 1)
    found = places.select("doc_id", "text_hash", "template", label.alias("label"), base.alias("base"), F.explode(verify("template", "d")).alias("s"))
    return found.select("doc_id", "text_hash", "template", "label", "base", "s.*")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: n_words, the base phrases' places, labels, and the best span's score (0 without one)."""
    found = spans(docs, doc_id, text)
    in_base = lambda c: F.when(F.col("base"), c)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of = found.groupBy("doc_id", "text_hash").agg(
        F.count(in_base(F.lit(1))).alias("n_base"), F.min(in_base(F.col("first"))).alias("first_word"), F.max(in_base(F.col("first"))).alias("last_word"),
        joined(in_base(F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score"),
    ).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    every = rows.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return every.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", zero("base_labels", ""), zero("labels", ""), zero("score", 0.0))
