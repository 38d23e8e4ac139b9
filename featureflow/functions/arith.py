"""Arithmetic expressions with IEEE-754 semantics under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")
NAN = float("nan")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_negative_zero(c: Column) -> Column:
    # -0.0 == 0.0 and Spark's atan2 normalises the sign, but the string form
    # keeps it; the cast only runs for a zero (AND short-circuits)
    return (c == 0) & c.cast("string").startswith("-")


def ieee_div(a, b, mode: str = "ieee") -> Column:
    """a / b for doubles: x/0 = ±inf (sign from x and the zero's sign),
    0/0 = NaN, NaN/0 = NaN. ``mode="null"`` gives null for a zero divisor.

    Spark's ``/`` raises on a zero divisor under ANSI and gives null
    otherwise; this keeps the column inside codegen without a UDF.
    """
    a, b = _col(a).cast("double"), _col(b).cast("double")
    if mode == "null":
        return F.try_divide(a, b)
    positive = (a > 0) != is_negative_zero(b)
    at_zero = (
        F.when(F.isnan(a) | (a == 0), F.lit(NAN))
        .when(positive, F.lit(INF))
        .otherwise(F.lit(-INF))
    )
    return F.when(b == 0, at_zero).otherwise(a / b)


def sum_of_products(pairs) -> Column:
    """a1*b1 + a2*b2 + ... evaluated left to right (same rounding as SQL)."""
    total = None
    for a, b in pairs:
        term = _col(a) * _col(b)
        total = term if total is None else total + term
    return total
