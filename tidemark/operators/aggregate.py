"""Aggregations over series, one group of labels and one time each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadData
from ..functions import labels as L
from ..functions.exprs import INF, NAN, lit, nan_first, quantile_of_sorted, text

def V() -> Column:  # noqa: N802  a column needs a running session
    return F.col("value")


def _real() -> Column:
    return F.when(~F.isnan(V()), V())


PLAIN = {
    "sum": lambda: F.sum(V()),
    "count": lambda: F.count("*").cast("double"),
    "min": lambda: F.coalesce(F.min(_real()), lit(NAN)),
    "max": lambda: F.coalesce(F.max(_real()), lit(NAN)),
    "avg": lambda: F.avg(V()),
    "stddev": lambda: F.stddev_pop(V()),
    "stdvar": lambda: F.var_pop(V()),
    "group": lambda: F.max(lit(1)),
}


def group_key(labels: tuple[str, ...], without: bool, grouped: bool) -> Column:
    if not grouped:
        return F.lit("")
    return L.drop(F.col("lkey"), (*labels, L.NAME)) if without else L.keep(F.col("lkey"), labels)


def simple(op: str, d: DataFrame, key: Column) -> DataFrame:
    return d.withColumn("lkey", key).groupBy("lkey", "ts").agg(PLAIN[op]().alias("value"))


def quantile(d: DataFrame, key: Column, phi: float) -> DataFrame:
    """Exact percentile. Without NaN the aggregate counts values, before and after the shuffle; a group
    with NaN is rare and is sorted as an array with its NaNs first."""
    g = d.withColumn("lkey", key).groupBy("lkey", "ts")
    if not 0 <= phi <= 1:
        return g.agg(F.max(lit(NAN if phi != phi else INF if phi > 1 else -INF)).alias("value"))
    counted = g.agg(F.percentile(_real(), F.lit(phi)).alias("p"), F.count_if(F.isnan(V())).alias("odd"), F.collect_list(F.when(F.isnan(V()), V())).alias("nans"), F.count("*").alias("n"))
    # with m NaNs in front, position phi * (n - 1) among all values is m places earlier among the real ones
    exact = d.withColumn("lkey", key).join(counted.where("odd > 0").select("lkey", "ts"), ["lkey", "ts"], "left_semi").groupBy("lkey", "ts").agg(F.collect_list(V()).alias("v"))
    mixed = exact.select("lkey", "ts", quantile_of_sorted(lit(phi), nan_first(F.col("v"))).alias("value"))
    return counted.where("odd = 0").select("lkey", "ts", F.col("p").alias("value")).unionByName(mixed)


def ranked(op: str, d: DataFrame, key: Column, k: int) -> DataFrame:
    """topk, bottomk and limitk: rows of k series a group, with their own labels. Rows are cut to k in
    salted parts first, so that a large group is never ranked in one task."""
    if k < 1:
        return d.limit(0)
    order = [F.col("lkey")] if op == "limitk" else [F.isnan(V()), V().desc() if op == "topk" else V().asc(), F.col("lkey")]
    d = d.withColumn("_g", key).withColumn("_salt", F.pmod(F.xxhash64("lkey"), F.lit(64)))
    for by in (("_g", "ts", "_salt"), ("_g", "ts")):
        d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)
    return d.drop("_g", "_salt", "_r")


def limit_ratio(d: DataFrame, ratio: float) -> DataFrame:
    """Series whose label hash, as a share of 2^64, is below the ratio; a negative one takes the rest."""
    r = max(-1.0, min(1.0, ratio))
    if r == 0:
        return d.limit(0)
    share = (F.xxhash64("lkey").cast("double") + 2.0**63) / 2.0**64
    return d.where(share < r if r > 0 else share >= 1 + r)


def count_values(d: DataFrame, key: Column, label: str) -> DataFrame:
    return d.withColumn("_g", key).withColumn("lkey", L.put(F.col("_g"), label, text(V()))).groupBy("lkey", "ts").agg(F.count("*").cast("double").alias("value"))


def aggregate(op: str, d: DataFrame, labels: tuple[str, ...], without: bool, grouped: bool, param: float | str | None) -> DataFrame:
    key = group_key(labels, without, grouped)
    if op in PLAIN:
        return simple(op, d, key)
    if op == "quantile":
        return quantile(d, key, param)
    if op == "count_values":
        return count_values(d, key, param)
    if param != param:
        raise BadData(f"{op} needs a number")
    if op == "limit_ratio":
        return limit_ratio(d, param)
    return ranked(op, d, key, int(max(-1.0, min(param, 2**31 - 1))))
