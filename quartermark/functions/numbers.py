"""Numbers: rounding as Python does, clamps, null-safe casts, small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def py_round(x: Column, digits: int = 0) -> Column:
    """Half-even on the exact binary value, as Python's round()."""
    if digits == 0:
        return F.rint(x)
    return F.regexp_replace(F.format_number(x, digits), ",", "").cast("double")


def safe_double(x: Column, default=None) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default).cast("double"))


def safe_int(x: Column, default=None) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default).cast("int"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ratio(cur: Column, prev: Column, even_if_both_zero: bool = False) -> Column:
    """cur / prev; infinite from zero, but 1 from zero to zero unless told otherwise."""
    infinite = F.lit(float("inf"))
    at_zero = infinite if even_if_both_zero else F.when(cur > 0, infinite).otherwise(F.lit(1.0))
    return F.when(F.coalesce(prev, F.lit(0)) <= 0, at_zero).otherwise(F.try_divide(cur.cast("double"), prev.cast("double")))


def per_thousand(count: Column, words: Column) -> Column:
    return count / F.greatest(words, F.lit(1)) * 1000


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def signed(x: Column) -> Column:
    return F.format_string("%+.1f", x)


def colour_band(x: Column) -> Column:
    return F.when(x >= 0.75, "green").when(x >= 0.55, "light").when(x >= 0.35, "amber").otherwise("red")
