"""Range-vector functions over windowed samples (lkey, ts, t, value[, pt, pv]).

Most functions are plain aggregates, so that Spark combines them before the shuffle and no window is ever
gathered. Functions of neighbours get each sample's predecessor (pt, pv) once, before windows are spread.
Only quantiles, deviations from the median and smoothing need a window's values in order, as an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import INF, NAN, divide, lit, nan_first, quantile_of_sorted
from .grid import seconds

#: Milliseconds of a slice of a series: the most that one task sorts of it.
SLICE = 86_400_000


def V() -> Column:  # noqa: N802  a column needs a running session
    return F.col("value")


def T() -> Column:  # noqa: N802
    return F.col("t")


def TS() -> Column:  # noqa: N802
    return F.col("ts")



def with_previous(samples: DataFrame, slice_ms: int = SLICE) -> DataFrame:
    """Adds time and value of the sample before in the series. A series is sorted slice by slice of time;
    only each slice's last sample, one row, is carried on to the next."""
    d = samples.withColumn("_s", F.floor(T() / slice_ms))
    tails = d.groupBy("lkey", "_s").agg(F.max(F.struct("t", "value")).alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy("lkey").orderBy("_s")))
    w = Window.partitionBy("lkey", "_s").orderBy("t")
    d = d.withColumn("_in", F.lag(F.struct("t", "value")).over(w)).join(tails, ["lkey", "_s"])
    return d.withColumn("_p", F.coalesce("_in", "_tail")).select("lkey", "t", "value", F.col("_p.t").alias("pt"), F.col("_p.value").alias("pv"))


def _nan_if(cond: Column, otherwise: Column) -> Column:
    return F.when(F.max(cond), lit(NAN)).otherwise(otherwise)


def _extrapolated(counter: bool, per_second: bool) -> Callable:
    def out(span: int, offset: int) -> list[Column]:
        within = F.col("pt") >= TS() - offset - span
        n = F.count("*")
        first, last = F.min(T()), F.max(T())
        v0, v1 = F.min_by(V(), T()), F.max_by(V(), T())
        drops = F.sum(F.when(within & (V() < F.col("pv")), F.col("pv")).otherwise(0.0))
        delta = v1 - v0 + (drops if counter else lit(0))
        sampled = seconds(last - first)
        gap = sampled / (n - 1)
        end = TS() - offset
        begin = seconds(first - (F.max(end) - span))
        after = seconds(F.max(end) - last)
        if counter:
            zero = divide(sampled * v0, delta)
            begin = F.when((delta > 0) & (v0 >= 0) & (zero < begin), zero).otherwise(begin)
        near = lambda x: F.when(x >= gap * 1.1, gap / 2).otherwise(x)
        value = delta * ((sampled + near(begin) + near(after)) / sampled)
        return [F.when(n >= 2, value / (span / 1000.0) if per_second else value).alias("value")]

    return out


def _last_two(kind: str) -> Callable:
    def out(span: int, offset: int) -> list[Column]:
        two = F.max_by(F.struct("t", "value", "pt", "pv"), T())
        step = seconds(two["t"] - two["pt"])
        plain = two["value"] - two["pv"]
        value = F.when(two["value"] < two["pv"], two["value"]).otherwise(plain) / step if kind == "irate" else plain
        odd = F.max(F.isnan(V())) if kind == "irate" else F.lit(False)
        enough = F.count("*") >= 2
        return [F.when(enough, F.when(odd, lit(NAN)).otherwise(value)).alias("value")]

    return out


def _pairs(kind: str) -> Callable:
    def out(span: int, offset: int) -> list[Column]:
        within = F.col("pt") >= TS() - offset - span
        if kind == "resets":
            hit = within & ~F.isnan(V()) & ~F.isnan("pv") & (V() < F.col("pv"))
            return [F.sum(F.when(hit, 1.0).otherwise(0.0)).alias("value")]
        odd = within & (F.isnan(V()) | F.isnan("pv"))
        return [_nan_if(F.coalesce(odd, F.lit(False)), F.sum(F.when(within & (V() != F.col("pv")), 1.0).otherwise(0.0))).alias("value")]

    return out


def _line(ahead: float | None) -> Callable:
    """Least-squares slope, or the line's value ``ahead`` seconds behind the evaluation time."""

    def out(span: int, offset: int) -> list[Column]:
        x = seconds(T() - TS())
        n = F.count("*")
        odd = F.max(F.isnan(V()))
        slope = F.coalesce(F.regr_slope(V(), x), lit(NAN))
        if ahead is None:
            value = slope
        else:
            flat = F.min(V()) == F.max(V())
            value = F.when(flat & (F.abs(F.max(V())) < INF), F.max(V())).otherwise(slope * ahead + F.coalesce(F.regr_intercept(V(), x), lit(NAN)))
            value = F.when(F.max(F.abs(V())) == INF, lit(NAN)).otherwise(value)
        return [F.when(n >= 2, F.when(odd, lit(NAN)).otherwise(value)).alias("value")]

    return out


def _simple(make: Callable[[], Column]) -> Callable:
    return lambda span, offset: [make().cast("double").alias("value")]


def _time_of(best: str) -> Callable:
    def out(span: int, offset: int) -> list[Column]:
        real = F.when(~F.isnan(V()), F.struct(V().alias("v"), (T() if best == "max" else -T()).alias("o"), T().alias("t")))
        pick = F.max(real) if best == "max" else F.min(real)
        return [seconds(F.coalesce(pick["t"], F.max(T()))).alias("value")]

    return out


AGGREGATES: dict[str, Callable] = {
    "sum_over_time": _simple(lambda: F.sum(V())),
    "avg_over_time": _simple(lambda: F.avg(V())),
    "min_over_time": _simple(lambda: _nan_if(F.isnan(V()), F.min(V()))),
    "max_over_time": _simple(lambda: F.max(V())),
    "count_over_time": _simple(lambda: F.count("*")),
    "stddev_over_time": _simple(lambda: F.stddev_pop(V())),
    "stdvar_over_time": _simple(lambda: F.var_pop(V())),
    "present_over_time": _simple(lambda: F.max(lit(1))),
    "last_over_time": _simple(lambda: F.max_by(V(), T())),
    "first_over_time": _simple(lambda: F.min_by(V(), T())),
    "ts_of_first_over_time": _simple(lambda: seconds(F.min(T()))),
    "ts_of_last_over_time": _simple(lambda: seconds(F.max(T()))),
    "ts_of_max_over_time": _time_of("max"),
    "ts_of_min_over_time": _time_of("min"),
    "delta": _extrapolated(False, False),
    "deriv": _line(None),
}
#: Functions that look at each sample's predecessor.
NEIGHBOURS: dict[str, Callable] = {
    "rate": _extrapolated(True, True),
    "increase": _extrapolated(True, False),
    "irate": _last_two("irate"),
    "idelta": _last_two("idelta"),
    "changes": _pairs("changes"),
    "resets": _pairs("resets"),
}
KEEP_NAME = frozenset(("last_over_time", "first_over_time"))


def _values() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda s: s["value"])


def ordered(name: str, windows: DataFrame, args: list[float]) -> DataFrame:
    """quantile_over_time, mad_over_time and double_exponential_smoothing, over arrays of a window."""
    d = windows.groupBy("lkey", "ts").agg(_values().alias("v"))
    if name == "quantile_over_time":
        d = d.withColumn("v", nan_first(F.col("v"))).select("lkey", "ts", quantile_of_sorted(lit(args[0]), F.col("v")).alias("value"))
    elif name == "mad_over_time":
        d = d.withColumn("m", quantile_of_sorted(lit(0.5), nan_first(F.col("v"))))
        d = d.withColumn("v", nan_first(F.transform("v", lambda x: F.abs(x - F.col("m"))))).select("lkey", "ts", quantile_of_sorted(lit(0.5), F.col("v")).alias("value"))
    else:
        sf, tf = args
        start = F.struct(F.get("v", F.lit(0)).alias("s"), (F.get("v", F.lit(1)) - F.get("v", F.lit(0))).alias("b"), F.lit(True).alias("first"))

        def step(a: Column, x: Column) -> Column:
            trend = F.when(a["first"], a["b"]).otherwise(a["b"])
            s = lit(sf) * x + lit(1 - sf) * (a["s"] + trend)
            return F.struct(s.alias("s"), (lit(tf) * (s - a["s"]) + lit(1 - tf) * trend).alias("b"), F.lit(False).alias("first"))

        rest = F.slice(F.col("v"), F.lit(2), F.size("v"))
        d = d.where(F.size("v") >= 2).select("lkey", "ts", F.aggregate(rest, start, step, lambda a: a["s"]).alias("value"))
    return d


ORDERED = frozenset(("quantile_over_time", "mad_over_time", "double_exponential_smoothing"))


def apply(name: str, windows: DataFrame, span: int, offset: int, args: list[float]) -> DataFrame:
    """(lkey, ts, value); empty windows and those too short give no row."""
    if name in ORDERED:
        return ordered(name, windows, args)
    make = _line(args[0]) if name == "predict_linear" else NEIGHBOURS.get(name) or AGGREGATES[name]
    # aggregates may use ts itself, which is constant within a group
    out = windows.groupBy("lkey", "ts").agg(*make(span, offset))
    return out.where(F.col("value").isNotNull())


FUNCTIONS = frozenset(AGGREGATES) | frozenset(NEIGHBOURS) | ORDERED | {"predict_linear"}
