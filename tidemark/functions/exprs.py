"""Floating-point expressions with IEEE results, where SQL would raise, give null or order NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, a * F.pow(b, lit(-1))).otherwise(a / F.when(b == 0, lit(1)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, lit(NAN)).otherwise(a % F.when(b == 0, lit(1)).otherwise(b))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divide(a, b), "%": lambda: modulo(a, b), "^": lambda: F.pow(a, b)}[op]()


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN equals nothing and has no order."""
    odd = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return odd | (a != b)
    return ~odd & {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def _log(fn, v: Column) -> Column:
    return F.when(v == 0, lit(-INF)).when(v < 0, lit(NAN)).when(F.isnan(v), lit(NAN)).otherwise(fn(F.when(v > 0, v)))


def _whole(fn, v: Column) -> Column:
    """ceil or floor as a double; values without a fraction pass."""
    big = F.isnan(v) | (F.abs(v) >= 2.0**52)
    return F.when(big, v).otherwise(fn(F.when(big, lit(0)).otherwise(v)).cast("double"))


MATH = {
    "abs": F.abs,
    "sgn": lambda v: F.when(F.isnan(v) | (v == 0), v).otherwise(F.signum(v)),
    "ceil": lambda v: _whole(F.ceil, v),
    "floor": lambda v: _whole(F.floor, v),
    "exp": F.exp,
    "ln": lambda v: _log(F.ln, v),
    "log2": lambda v: _log(F.log2, v),
    "log10": lambda v: _log(F.log10, v),
    "sqrt": F.sqrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "deg": lambda v: v * 180.0 / lit(math.pi),
    "rad": lambda v: v * lit(math.pi) / 180.0,
}


def _calendar(fn):
    def out(v: Column) -> Column:
        odd = F.isnan(v) | (F.abs(v) > 1e11)
        return F.when(odd, lit(NAN)).otherwise(fn(F.timestamp_seconds(F.when(odd, lit(0)).otherwise(v).cast("long"))).cast("double"))

    return out


#: Functions of a time in seconds, in UTC.
DATES = {
    "minute": _calendar(F.minute),
    "hour": _calendar(F.hour),
    "day_of_week": _calendar(lambda t: F.dayofweek(t) - 1),
    "day_of_month": _calendar(F.dayofmonth),
    "day_of_year": _calendar(F.dayofyear),
    "days_in_month": _calendar(lambda t: F.dayofmonth(F.last_day(t))),
    "month": _calendar(F.month),
    "year": _calendar(F.year),
}


def clamp_min(v: Column, lo: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(lo), lit(NAN)).otherwise(F.greatest(v, lo))


def clamp_max(v: Column, hi: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(hi), lit(NAN)).otherwise(F.least(v, hi))


def round_to(v: Column, unit: Column) -> Column:
    """Nearest multiple, halves away from zero."""
    q = divide(v, unit)
    return F.when(F.isnan(q) | (F.abs(q) == INF), v).otherwise(F.when(q >= 0, _whole(F.floor, q + 0.5)).otherwise(_whole(F.ceil, q - 0.5)) * unit)


def text(v: Column) -> Column:
    """A float as the shortest decimal without an exponent, for label values."""
    shown = v.cast("string")
    part = lambda k: F.regexp_extract(shown, r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", k)
    whole, exponent = part(1), F.coalesce(F.expr("0") + F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    digits = F.concat(whole, F.regexp_replace(part(2), "0+$", ""))
    point = F.length(whole) + exponent
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), F.regexp_replace(digits, "^0+(?=.)", ""))
    large = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    inner = F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, F.length(digits)))
    plain = F.when(point >= F.length(digits), large).when(point <= 0, small).otherwise(inner)
    signed = F.concat(F.when(F.startswith(shown, F.lit("-")), F.lit("-")).otherwise(F.lit("")), plain)
    return F.when(F.isnan(v), F.lit("NaN")).when(v == INF, F.lit("+Inf")).when(v == -INF, F.lit("-Inf")).otherwise(signed)


def quantile_of_sorted(phi: Column, values: Column) -> Column:
    """Linear interpolation at phi * (n - 1) of an ascending array whose NaNs stand first."""
    n = F.size(values)
    rank = phi * (n - 1).cast("double")
    low = F.greatest(F.lit(0), F.least(n - 1, F.floor(rank).cast("int")))
    high = F.least(n - 1, low + 1)
    share = rank - F.floor(rank).cast("double")
    inner = F.get(values, low) * (1 - share) + F.get(values, high) * share
    return F.when(F.isnan(phi) | (n == 0), lit(NAN)).when(phi < 0, lit(-INF)).when(phi > 1, lit(INF)).otherwise(inner)


def nan_first(values: Column) -> Column:
    """An ascending array; Spark sorts NaN last."""
    s = F.array_sort(values)
    return F.concat(F.filter(s, F.isnan), F.filter(s, lambda x: ~F.isnan(x)))
