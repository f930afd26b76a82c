"""Exact sums against math.fsum, whatever the partitions."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tallyspan.functions import exact


def test_sums_equal_fsum(spark):
    rng, rows = random.Random(3), []
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300), lambda: rng.choice([1e16, 1.0, -1e16]), lambda: math.ldexp(rng.randint(1, 9), rng.randint(-1074, -1000)), lambda: 2.0 ** rng.randint(-1022, 1000), lambda: 0.0, lambda: -5e5 * rng.random()]
    for g, kind in enumerate(kinds):
        rows += [(g, kind()) for _ in range(300)]
    rows += [(90, math.inf), (90, 1.0), (91, math.inf), (91, -math.inf), (92, math.nan), (93, None), (94, None), (94, 2.5), (95, 1.7e308), (95, 1.7e308), (96, -0.0), (97, 1.0), (97, 1e-320), (97, -1.0)]
    got = []
    for parts in (3, 7):
        df = spark.createDataFrame(rows, "g long, x double").repartition(parts)
        got.append({(r["g"], r["name"]): r["total"] for r in exact.exact_sums(df, ["g"], x=F.col("x"), double=F.col("x") * 2).collect()})
    assert str(sorted(got[0].items())) == str(sorted(got[1].items()))
    for g in {g for g, _ in rows}:
        x = [v for h, v in rows if h == g and v is not None]
        for name, f in (("x", 1), ("double", 2)):
            have = got[0][g, name]
            try:
                want = math.fsum(f * v for v in x) if x else None
            except ValueError:
                want = math.nan
            except OverflowError:
                want = math.inf
            assert have == want or (want is not None and math.isnan(want) and math.isnan(have)), (g, name, have, want)
    assert exact.exact_sums(spark.createDataFrame([], "g long, x double"), [], x=F.col("x")).collect() == []


def test_powers_of_two_are_exact(spark):
    got = spark.range(-1022, 1024).select("id", F.pow(F.lit(2.0), F.col("id")).alias("p")).collect()
    assert all(r["p"] == math.ldexp(1.0, r["id"]) for r in got)
    x = np.random.default_rng(1).standard_normal(500) * 2.0 ** np.random.default_rng(2).integers(-1000, 1000, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", exact.parts(F.col("x")).alias("p"))
    assert all(Fraction((r["p"]["hi"] << exact.LOW) + r["p"]["lo"]) * Fraction(2) ** (r["p"]["e"] - 53) == Fraction(r["x"]) for r in df.collect())
