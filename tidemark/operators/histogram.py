"""Classic histograms: buckets of one series and time as a short sorted array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exprs import lit
from ..plans.ast import number_text

INF = "double('Infinity')"
NAN = "double('NaN')"


def buckets(d: DataFrame) -> DataFrame:
    """lkey, ts and b: (le, c) ascending by bound, equal bounds summed, counts made monotone; rows
    without a readable bound are skipped."""
    le = L.get(F.col("lkey"), "le")
    bound = F.when(le.isin("+Inf", "Inf", "inf", "+inf"), lit(float("inf"))).otherwise(le.try_cast("double"))
    rows = d.withColumn("le", bound).where(F.col("le").isNotNull() & ~F.isnan("le")).withColumn("lkey", L.drop(F.col("lkey"), (L.NAME, "le")))
    summed = rows.groupBy("lkey", "ts", "le").agg(F.sum("value").alias("c"))
    lists = summed.groupBy("lkey", "ts").agg(F.array_sort(F.collect_list(F.struct("le", "c"))).alias("raw"))
    running = "aggregate(raw, cast(array() AS array<struct<le:double,c:double>>), (a, x) -> array_append(a, struct(x.le AS le, CASE WHEN size(a) > 0 AND get(a, size(a) - 1).c > x.c THEN get(a, size(a) - 1).c ELSE x.c END AS c)))"
    out = lists.withColumn("b", F.expr(running)).withColumn("n", F.size("b")).withColumn("total", F.expr("get(b, n - 1).c"))
    return out.withColumn("good", F.expr(f"n >= 2 AND get(b, n - 1).le = {INF}")).drop("raw")


def _segments() -> str:
    """(lo, up, prev, c) of each bucket; the first one begins at 0, or below everything."""
    return f"transform(b, (x, i) -> struct(CASE WHEN i > 0 THEN get(b, i - 1).le WHEN x.le <= 0 THEN -{INF} ELSE 0D END AS lo, x.le AS up, CASE WHEN i > 0 THEN get(b, i - 1).c ELSE 0D END AS prev, x.c AS c))"


def quantile(d: DataFrame, phi: float) -> DataFrame:
    b = buckets(d)
    if not 0 <= phi <= 1:
        edge = NAN if phi != phi else INF if phi > 1 else f"-{INF}"
        return b.select("lkey", "ts", F.expr(edge).alias("value"))
    b = b.withColumn("rank", lit(phi) * F.col("total")).withColumn("seg", F.expr(_segments()))
    b = b.withColumn("i", F.expr("coalesce(array_position(transform(slice(b, 1, greatest(n - 1, 1)), x -> x.c >= rank), true), n) - 1").cast("int")).withColumn("s", F.expr("get(seg, i)"))
    inner = f"CASE WHEN i < 0 OR i = n - 1 THEN get(b, n - 2).le WHEN i = 0 AND s.up <= 0 THEN s.up WHEN s.c - s.prev <= 0 THEN {NAN} ELSE s.lo + (s.up - s.lo) * ((rank - s.prev) / (s.c - s.prev)) END"
    return b.select("lkey", "ts", F.expr(f"CASE WHEN NOT good OR NOT (total > 0) OR isnan(total) THEN {NAN} ELSE {inner} END").alias("value"))


def quantiles(d: DataFrame, label: str, phis: list[float]) -> DataFrame:
    """One output series for each quantile, named by ``label``."""
    out = None
    for phi in phis:
        q = quantile(d, phi)
        q = q.withColumn("lkey", L.put(F.col("lkey"), label, F.lit(number_text(phi) if phi != int(phi) else f"{phi:.1f}")))
        out = q if out is None else out.unionByName(q)
    return out


def fraction(d: DataFrame, low: float, high: float) -> DataFrame:
    b = buckets(d).withColumn("seg", F.expr(_segments()))
    for name, x in (("below", low), ("upto", high)):
        b = b.withColumn("x", lit(x)).withColumn("s", F.expr("get(filter(seg, y -> y.up > x), 0)"))
        b = b.withColumn(name, F.expr(f"CASE WHEN s IS NULL THEN total WHEN s.lo >= x THEN s.prev WHEN s.lo = -{INF} THEN s.c WHEN s.up = {INF} THEN s.prev ELSE s.prev + (s.c - s.prev) * (x - s.lo) / (s.up - s.lo) END"))
    odd = "true" if low != low or high != high else "false"
    flat = "true" if low >= high else "false"
    value = f"CASE WHEN NOT good OR total = 0 OR isnan(total) OR {odd} THEN {NAN} WHEN {flat} THEN 0D ELSE (least(upto, total) - least(below, total)) / total END"
    return b.select("lkey", "ts", F.expr(value).alias("value"))


def moments(d: DataFrame, name: str) -> DataFrame:
    """count, sum, avg, stdvar and stddev from bucket midpoints."""
    b = buckets(d)
    middle = f"transform(b, (x, i) -> struct(greatest(0D, x.c - CASE WHEN i > 0 THEN get(b, i - 1).c ELSE 0D END) AS w, CASE WHEN x.le = {INF} THEN CASE WHEN i > 0 THEN get(b, i - 1).le ELSE 0D END WHEN i = 0 THEN CASE WHEN x.le <= 0 THEN x.le ELSE x.le / 2 END ELSE get(b, i - 1).le + (x.le - get(b, i - 1).le) / 2 END AS m))"
    b = b.withColumn("p", F.expr(middle)).withColumn("sum", F.expr("aggregate(p, 0D, (a, x) -> a + x.w * x.m)"))
    b = b.withColumn("mean", F.expr(f"CASE WHEN total > 0 THEN sum / total ELSE {NAN} END"))
    b = b.withColumn("var", F.expr(f"CASE WHEN total > 0 THEN aggregate(p, 0D, (a, x) -> a + x.w * (x.m - mean) * (x.m - mean)) / total ELSE {NAN} END"))
    value = {"count": "total", "sum": "sum", "avg": "mean", "stdvar": "var", "stddev": "sqrt(var)"}[name]
    return b.select("lkey", "ts", F.expr(f"CASE WHEN NOT good THEN {NAN} ELSE {value} END").alias("value"))
