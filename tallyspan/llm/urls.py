"""URL filters: rules by host and path, and for the rest a naive Bayes score over segmented host and path tokens.

Names in hosts are often words run together. A unigram model, counted over the words of all pages, splits them:
every piece of a distinct name is looked up by a join, and Viterbi picks the likeliest split. Words of more than LONGEST_WORD letters are
never split off: a name's pieces are then in proportion to its length. Multinomial naive Bayes then scores the host's words and the path's.

It is trained on all pages, on the same features that it scores. A page that a rule decides has the rule's verdict as its label; of the others, those whose host has
one of SEEDS among its words count as ones to block. The rest have no label: nobody has said that they are fine, so they count as ones to allow with the weight UNLABELLED only.
Features are kept apart by field: words of the host but its suffix, words of the path after the first, and the suffix together with the path's first word, alone and with the first
letter of the second. Rules speak of suffix and path start together, so neither is a feature of its own: no suffix and no language decides a verdict. Features are counted in
BUCKETS hash buckets, so the model's size is fixed and every one is counted.

A null url, or one without ://, has an empty host and path, fits no rule and gets the verdict of the prior.
Null html counts as empty; an empty table gives none. Urls and pages of any length are read whole. Repeated rows get the same verdict; page_id and extra columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.plans.scratch import store

#: (verdict, host, path start)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words that mark a host as one to block when the model is trained.
SEEDS = frozenset("spam pills casino poker porn xxx viagra cialis bet bets betting gambling jackpot escort replica torrent warez phishing malware".split())
#: What a page without a label counts as one to allow, against 1 for a page with a label.
UNLABELLED = 0.25
BUCKETS = 1 << 18
LONGEST_WORD = 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """Runs of letters, digits and anything beyond ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(lower(c), F.lit(_TOKEN), F.lit(0))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ://, up to /, ?, # or the end, lower-cased; then up to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains if the path starts with its own."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r), value(r)).otherwise(rest), reversed(longest), F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): the words of all pages' visible text, digits apart, seen twice or more, and the seeds."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(tokens(text)).alias("word")).where(F.length("word").between(1, LONGEST_WORD) & ~F.col("word").rlike("[0-9]"))
    seeds = pages.sparkSession.createDataFrame([(w,) for w in sorted(SEEDS)], "word string")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    # a seed is a word even where no page uses it
    return counts.where("n >= 2").unionByName(seeds.withColumn("n", F.lit(2).cast("long"))).groupBy("word").agg(F.sum("n").alias("n"))


def split(name: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split of a name. known: (start, length) -> count. A stretch without known words stays whole."""
    best, back = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    starts: dict[int, list[tuple[int, float]]] = {}
    for (start, length), n in known.items():
        starts.setdefault(start, []).append((length, math.log(total / n)))
    for s in range(len(name)):
        for length, cost in (*starts.get(s, ()), (1, math.log(total) + 5)):
            if best[s] + cost < best[s + length]:
                best[s + length], back[s + length] = best[s] + cost, s
    parts, end = [], len(name)
    while end:
        parts.append((back[end], end))
        end = back[end]
    out, open_ = [], False
    for s, e in reversed(parts):
        unknown = (s, e - s) not in known
        if unknown and open_:
            out[-1] += name[s:e]
        else:
            out.append(name[s:e])
        open_ = unknown
    return out


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, parts) for distinct names: each split by Viterbi over the unigrams."""

    @F.pandas_udf("array<string>")
    def viterbi(name: pd.Series, at: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([split(n, {(x["s"], x["l"]): x["n"] for x in k}, int(t)) for n, k, t in zip(name, at, total, strict=True)], dtype=object)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for base in range(0, len(name), 1024):  # a long name leaves in small batches
                    at = [(s, n) for s in range(base, min(base + 1024, len(name))) for n in range(1, min(LONGEST_WORD, len(name) - s) + 1)]
                    columns = [pa.array([name] * len(at)), *(pa.array(c, pa.int32()) for c in zip(*at, strict=True)), pa.array([name[s : s + n] for s, n in at])]
                    yield pa.RecordBatch.from_arrays(columns, names=["name", "s", "l", "word"])

    found = names.select("name").mapInArrow(pieces, "name string, s int, l int, word string").join(words, "word").groupBy("name").agg(F.collect_list(F.struct("s", "l", "n")).alias("at"))
    total = words.agg(F.sum("n")).first()[0] or 1
    none = F.array().cast("array<struct<s:int,l:int,n:bigint>>")
    return names.join(found, "name", "left").select("name", viterbi("name", F.coalesce(F.col("at").cast("array<struct<s:int,l:int,n:bigint>>"), none), F.lit(total)).alias("parts"))


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the segmented words of each distinct host's names but the last, in order."""
    names = hosts.select("host", F.posexplode(_names(F.col("host"))).alias("k", "name"))
    parts = segmented(names.select("name").distinct(), words)
    return names.join(parts, "name").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "parts"))), lambda x: x["parts"])).alias("words"))


def _names(host: Column) -> Column:
    """A host's names without a port and without the last one, its suffix."""
    names = tokens(F.regexp_replace(host, ":[0-9]*$", ""))
    return F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))


def fields(words: Column, host: Column, path: Column) -> Column:
    """Features by field. Numbers count by their length only, but for the letter that the second word of a path starts with."""
    plain = lambda w: F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w)
    of = lambda kind, some: F.transform(some, lambda w: F.concat(F.lit(kind), plain(w)))
    way = tokens(path)
    first, second = F.coalesce(F.get(way, F.lit(0)), F.lit("")), F.coalesce(F.get(way, F.lit(1)), F.lit(""))
    place = F.concat(F.regexp_extract(host, r"([^.:]*)(?::[0-9]*)?$", 1), F.lit("/"), plain(first))
    both = F.array(F.concat(F.lit("place:"), place), F.concat(F.lit("start:"), place, F.lit("/"), F.substring(second, 1, 1)))
    return F.concat(of("host:", words), both, of("path:", F.slice(way, 2, F.greatest(F.size(way) - 1, F.lit(0)))))


def _buckets(features: Column) -> Column:
    return F.transform(features, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


def train(features: DataFrame, unlabelled: float = UNLABELLED) -> tuple[float, np.ndarray]:
    """(prior, log ratio by bucket) of multinomial naive Bayes with add-one smoothing. features: (buckets, label), all pages; a null label counts as one to allow by `unlabelled`."""
    block = F.coalesce("label", F.lit(False))
    weight = F.when(F.col("label").isNull(), unlabelled).otherwise(1.0)
    features = features.select("buckets", F.when(block, 1.0).otherwise(0.0).alias("bad"), F.when(block, 0.0).otherwise(weight).alias("good"))
    classes = features.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    counts = features.select(F.explode("buckets").alias("b"), "bad", "good").groupBy("b").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    bad, good = np.ones(BUCKETS), np.ones(BUCKETS)
    at = counts["b"].to_numpy()
    bad[at] += counts["bad"].to_numpy()
    good[at] += counts["good"].to_numpy()
    used = len(at) + 1
    ratio = np.log(bad / (bad.sum() - BUCKETS + used)) - np.log(good / (good.sum() - BUCKETS + used))
    if not classes["bad"] or not classes["good"]:  # one class only: nothing to tell apart
        ratio[:] = 0
    return math.log(((classes["bad"] or 0.0) + 1) / ((classes["good"] or 0.0) + 1)), ratio.astype(np.float32)


def labelled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows (host, path, words of the host) with rule, by_rule, label (true: to block; null: none) and features."""
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    seeds = F.array(*map(F.lit, sorted(SEEDS)))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), fields(F.col("words"), F.col("host"), F.col("path")).alias("features"))
    seeded = F.exists("words", lambda w: F.array_contains(seeds, w))
    return rows.withColumn("label", F.when(F.col("rule").isNotNull(), F.col("by_rule") == "block").when(seeded, True))


def report(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, fit_on: Column | None = None) -> DataFrame:
    """One row per page: host, path, rule, verdict, the label that it is trained with (null: none), and the naive Bayes log odds that it is one to block.

    fit_on: a condition on page_id, host or path, such as a hold-out rule; the model is trained on the pages that meet it.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    words = store(host_words(rows.select("host").distinct(), store(unigrams(pages, html), "unigrams")), "hosts")
    rows = rows.join(words, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    slim = labelled(rows, rules).withColumn("features", _buckets(F.col("features")))
    slim = store(slim.drop("words"), "urls")
    prior, ratio = train((slim if fit_on is None else slim.where(fit_on)).select(F.col("features").alias("buckets"), "label"))

    @F.pandas_udf("double")
    def log_odds(buckets: pd.Series) -> pd.Series:
        return pd.Series([prior + float(ratio[np.asarray(b, np.int64)].sum()) for b in buckets], dtype=float)

    out = slim.select("page_id", "host", "path", "rule", "by_rule", "label", log_odds("features").alias("log_odds"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "label", "log_odds")
