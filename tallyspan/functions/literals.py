"""Parsing and spelling of the text fields of observation and annotation tables, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_HEX = r"^([+-]?)0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?$"
NAN, INFINITY = float("nan"), float("inf")


def number(text: Column) -> Column:
    """A decimal or hexadecimal literal as double; anything else is NaN. No blanks, underscores, suffixes or non-ASCII digits.

    Hexadecimal digits count up to 15; longer literals are NaN.
    """
    digits = F.concat(F.regexp_extract(text, _HEX, 2), F.regexp_extract(text, _HEX, 3))
    power = F.coalesce(F.regexp_extract(text, _HEX, 4).try_cast("double"), F.lit(0.0)) - 4.0 * F.length(F.regexp_extract(text, _HEX, 3))
    sign = F.when(F.regexp_extract(text, _HEX, 1) == "-", -1.0).otherwise(1.0)
    hexadecimal = sign * F.conv(digits, 16, 10).cast("double") * F.pow(F.lit(2.0), power)
    infinite = F.when(F.lower(text).rlike(r"^\+?inf(inity)?$"), INFINITY).when(F.lower(text).rlike(r"^-inf(inity)?$"), -INFINITY)
    value = F.when(text.rlike(_DECIMAL), text.try_cast("double")).when(text.rlike(_HEX) & F.length(digits).between(1, 15), hexadecimal).otherwise(infinite)
    return F.coalesce(value, F.lit(NAN))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY)


def integral(x: Column) -> Column:
    return finite(x) & (x == F.floor(x))


def chromosome(text: Column) -> Column:
    """1..22 from a name with or without chr in front; else null."""
    plain = F.regexp_replace(text, r"^(?i)chr", "")
    n = F.when(plain.rlike(r"^[0-9]+$"), plain.try_cast("long"))
    return F.when(n.between(1, 22), n)


def coordinate(text: Column) -> Column:
    """A position, 1 to 2**31 - 1; null if it is no such whole number."""
    x = number(text)
    return F.when(integral(x) & (x >= 1) & (x <= 2147483647), x.cast("long"))


def spelling(position: Column) -> Column:
    """The shorter of a whole number's fixed and scientific spelling, fixed if even: 100000 is 1e+05."""
    fixed = position.cast("string")
    digits = F.regexp_replace(fixed, "0+$", "")
    rest = F.substring(digits, 2, 20)
    scientific = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e+"), F.lpad((F.length(fixed) - 1).cast("string"), 2, "0"))
    return F.when((position > 0) & (F.length(scientific) < F.length(fixed)), scientific).otherwise(fixed)
