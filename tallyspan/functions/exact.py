"""Sums of doubles that do not depend on the order or the partitions of the rows: exact, and rounded once.

A double is a whole number of at most 55 bits, with room for a misjudged exponent, times a power of two. For each power the whole numbers' upper and lower bits are added up as longs, before the shuffle as after it, which is
exact in any order for up to 2^34 rows; what is left, two longs for each power that occurs, is put together as one whole number and rounded to the nearest double.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a lower part.
LOW = 28
#: Smaller numbers than 2^-TINY are scaled up before they are taken apart, so that no power of two leaves the range of doubles.
TINY, UP = 900, 500


def parts(x: Column) -> Column:
    """struct(e, hi, lo) of a finite number: x = (hi * 2^LOW + lo) * 2^(e - 53)."""
    tiny = F.abs(x) < F.lit(2.0**-TINY)
    scaled = F.when(tiny, x * F.lit(2.0**UP)).otherwise(x)
    power = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(scaled)))).cast("int")
    whole = scaled * F.pow(F.lit(2.0), F.lit(53) - power)
    whole = F.when(whole == F.floor(whole), whole).otherwise(F.raise_error(F.lit("a number could not be taken apart")).cast("double"))
    hi = F.floor(whole / F.lit(2.0**LOW))
    return F.struct((power - F.when(tiny & (x != 0), UP).otherwise(0)).alias("e"), hi.cast("long").alias("hi"), (whole - hi * F.lit(2.0**LOW)).cast("long").alias("lo"))


def _rounded(limbs: pd.Series) -> pd.Series:
    out = []
    for some in limbs:
        least = min(x["e"] for x in some)
        total = sum(((int(x["hi"]) << LOW) + int(x["lo"])) << (int(x["e"]) - least) for x in some)
        shift = int(least) - 53
        try:
            out.append(float(total << shift) if shift >= 0 else total / (1 << -shift))
        except OverflowError:
            out.append(float("inf") if total > 0 else float("-inf"))
    return pd.Series(out, dtype=float)


def exact_sums(rows: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """(by..., name, total) for each of the named values: its sum, correctly rounded. Nulls don't count, and a group without a value has a null; infinities and NaN give what adding them up gives."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("x")) for n, v in values.items()])).alias("v")).select(*by, "v.*")
    odd = F.isnan("x") | (F.abs("x") == float("inf"))
    taken = long.select(*by, "name", F.when(~odd, parts(F.when(odd, 0.0).otherwise(F.col("x")))).alias("p"), F.when(odd, F.col("x")).alias("odd"))
    sums = taken.groupBy(*by, "name", F.col("p.e").alias("e")).agg(F.sum("p.hi").alias("hi"), F.sum("p.lo").alias("lo"), F.sum("odd").alias("odd"))
    every = sums.groupBy(*by, "name").agg(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "hi", "lo"))).alias("limbs"), F.sum("odd").alias("odd"))  # one for each power of two at most
    none = F.size("limbs") == 0
    total = F.pandas_udf(_rounded, "double")(F.when(none, F.array(F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo")))).otherwise(F.col("limbs")))
    return every.select(*by, "name", F.when(F.col("odd").isNotNull(), F.col("odd")).when(none, None).otherwise(total).alias("total"))
