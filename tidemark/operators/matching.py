"""Vector matching: joins of two vectors on labels and time, and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exprs import arithmetic, compare, lit
from ..plans.ast import Matching


def match_key(m: Matching, key: Column) -> Column:
    return L.keep(key, m.labels) if m.on else L.drop(key, (*m.labels, L.NAME))


def guarded(value: Column, bad: Column, message: str) -> Column:
    """The value, or an error where ``bad``; as part of the value it cannot be pruned away."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def unique(d: DataFrame, message: str) -> DataFrame:
    """Rows with one value a label set and time; two are an error when evaluated."""
    return d.groupBy("lkey", "ts").agg(F.max("value").alias("value"), F.count("*").alias("_n")).select("lkey", "ts", guarded(F.col("value"), F.col("_n") > 1, message).alias("value"))


def _one(d: DataFrame, m: Matching, side: str, message: str) -> DataFrame:
    """A side with at most one series a match key."""
    g = d.withColumn("mkey", match_key(m, F.col("lkey"))).groupBy("mkey", "ts").agg(F.max("value").alias("_v"), F.min("lkey").alias(f"{side}key"), F.count("*").alias("_n"))
    return g.select("mkey", "ts", f"{side}key", guarded(F.col("_v"), F.col("_n") > 1, message).alias(f"{side}v"))


def binary(op: str, left: DataFrame, right: DataFrame, m: Matching, bool_: bool, comparison: bool) -> DataFrame:
    """One-to-one, many-to-one and one-to-many matching with fills."""
    many = m.card == "many-to-one" and "l" or m.card == "one-to-many" and "r" or ""
    sides = {}
    for side, d in (("l", left), ("r", right)):
        if side == many:
            sides[side] = d.select(match_key(m, F.col("lkey")).alias("mkey"), "ts", F.col("lkey").alias(f"{side}key"), F.col("value").alias(f"{side}v"))
        else:
            sides[side] = _one(d, m, side, f"found duplicate series for the match group on the {'left' if side == 'l' else 'right'} hand-side of the operation")
    how = {(False, False): "inner", (True, False): "right", (False, True): "left", (True, True): "full"}[m.fill_left is not None, m.fill_right is not None]
    j = sides["l"].join(sides["r"], ["mkey", "ts"], how)
    lv = F.col("lv") if m.fill_left is None else F.coalesce("lv", lit(m.fill_left))
    rv = F.col("rv") if m.fill_right is None else F.coalesce("rv", lit(m.fill_right))
    lkey, rkey = F.coalesce("lkey", "mkey"), F.coalesce("rkey", "mkey")
    if many:
        base, other = (lkey, rkey) if many == "l" else (rkey, lkey)
        key = base if comparison and not bool_ else L.drop(base, (L.NAME,))
        for name in m.include:
            key = L.put(key, name, L.get(other, name))
    elif m.on:
        key = L.keep(lkey, m.labels)
    else:
        key = L.drop(lkey, m.labels if comparison and not bool_ else (*m.labels, L.NAME))
    # all columns are computed before the key replaces lkey
    j = j.select(key.alias("_key"), "ts", lv.alias("_l"), rv.alias("_r"))
    if comparison:
        hit = compare(op, F.col("_l"), F.col("_r"))
        j = j.withColumn("value", F.when(hit, 1.0).otherwise(0.0)) if bool_ else j.where(hit).withColumn("value", F.col("_l"))
    else:
        j = j.withColumn("value", arithmetic(op, F.col("_l"), F.col("_r")))
    out = j.select(F.col("_key").alias("lkey"), "ts", "value")
    return unique(out, "multiple matches for labels: grouping labels must ensure unique matches") if many or m.on and comparison else out


def set_operation(op: str, left: DataFrame, right: DataFrame, m: Matching) -> DataFrame:
    l = left.withColumn("mkey", match_key(m, F.col("lkey")))  # noqa: E741
    r = right.withColumn("mkey", match_key(m, F.col("lkey")))
    keys = lambda d: d.select("mkey", "ts").distinct()
    if op == "and":
        return l.join(keys(r), ["mkey", "ts"], "left_semi").select("lkey", "ts", "value")
    if op == "unless":
        return l.join(keys(r), ["mkey", "ts"], "left_anti").select("lkey", "ts", "value")
    extra = r.join(keys(l), ["mkey", "ts"], "left_anti")
    return left.select("lkey", "ts", "value").unionByName(extra.select("lkey", "ts", "value"))


def info(base: DataFrame, infos: DataFrame, wanted: list | None, optional: bool) -> DataFrame:
    """Adds labels of info series that share instance and job; ``wanted`` names them, None takes all.
    A series without a match stays only if ``optional``."""
    match = Matching(("instance", "job"), True, True)
    one = _one(infos, match, "i", "found duplicate series for info metric")
    b = base.withColumn("mkey", match_key(match, F.col("lkey")))
    j = b.join(one, ["mkey", "ts"], "left" if optional else "inner")
    mine = F.transform(L.parts(F.col("lkey")), lambda p: F.substring_index(p, L.KV, 1))
    fresh = F.filter(L.parts(F.coalesce("ikey", F.lit(""))), lambda p: ~F.array_contains(mine, F.substring_index(p, L.KV, 1)) & (F.substring_index(p, L.KV, 1) != L.NAME) & (F.substring_index(p, L.KV, 1).isin(*wanted) if wanted else F.lit(wanted is None)))
    # the comparison makes the check for duplicate info series part of the value
    value = F.when(F.coalesce("iv", lit(0)) == float("inf"), F.col("value") + 0.0).otherwise(F.col("value"))
    return j.select(L.joined(F.concat(L.parts(F.col("lkey")), fresh)).alias("lkey"), "ts", value.alias("value"))
