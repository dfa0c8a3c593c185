"""Sources of samples: wide tables with label columns, and series/samples table pairs.

A source answers ``scan(matchers, low, high)`` with rows (lkey, t, value): label key, milliseconds, double.
Stale markers are left out by ``stale`` at ingest. Time bounds and matchers on label columns are plain
column predicates, which reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..plans.ast import Matcher


def matches(value: Column, m: Matcher) -> Column:
    """A matcher on a label's value, absent ones read as empty; patterns match the whole value."""
    if m.op in ("=", "!="):
        hit = value == F.lit(m.value)
        return hit if m.op == "=" else ~hit
    hit = value.rlike(rf"\A(?:{m.value})\z")
    return hit if m.op == "=~" else ~hit


def matches_text(value: str, m: Matcher) -> bool:
    hit = value == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, value) is not None
    return hit == (m.op in ("=", "=~"))


def within(d: DataFrame, column: str, low: int | None, high: int | None) -> DataFrame:
    """Rows whose time in a timestamp column is from ``low`` to ``high`` ms, where given: predicates on the
    plain column, which the Parquet scan prunes by."""
    edge = lambda ms: F.timestamp_millis(F.lit(ms).cast("long")).cast(d.schema[column].dataType)
    if low is not None:
        d = d.where(F.col(column) >= edge(low))
    return d if high is None else d.where(F.col(column) < edge(high + 1))


@dataclass(frozen=True)
class Metric:
    """One metric in a table of its own. ``labels`` names label columns; ``at`` is a column of
    milliseconds. ``bound`` names the raw time column, so that the scan can prune. ``rows`` may be a
    function of both bounds (or None), for a table that is computed from the rows within them."""

    name: str
    rows: DataFrame | Callable[[int | None, int | None], DataFrame]
    labels: tuple[str, ...]
    at: str = "t"
    value: str = "value"
    bound: str | None = None

    def table(self, low: int | None = None, high: int | None = None) -> DataFrame:
        return self.rows(low, high) if callable(self.rows) else self.rows

    def scan(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        d = self.table(low, high)
        if self.bound and low is not None:
            d = within(d, self.bound, low, high)
        for m in matchers:
            if m.label != L.NAME:
                known = F.coalesce(F.col(m.label).cast("string"), F.lit("")) if m.label in self.labels else F.lit("")
                # an equality that cannot hold for null needs no coalesce and can be pushed down
                plain = m.op == "=" and m.value and m.label in self.labels and dict(d.dtypes)[m.label] == "string"
                d = d.where(F.col(m.label) == m.value if plain else matches(known, m))
        key = L.from_columns({L.NAME: F.lit(self.name)} | {n: F.col(n) for n in self.labels})
        out = d.select(key.alias("lkey"), F.col(self.at).cast("long").alias("t"), F.coalesce(F.col(self.value).cast("double"), F.lit(float("nan"))).alias("value"))
        return out if low is None else out.where(F.col("t").between(low, high))

    def series(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        return self.scan(matchers, low, high).select("lkey").distinct()


@dataclass(frozen=True)
class SeriesStore:
    """The pair of tables ``series`` (id, metric_name, labels, min_time, max_time) and ``samples``
    (id, ts_ms, value, is_stale). Columns of ``series`` named in ``promoted`` hold a label each."""

    series_rows: DataFrame
    sample_rows: DataFrame
    promoted: tuple[str, ...] = ()

    def _label(self, name: str) -> Column:
        if name == L.NAME:
            return F.col("metric_name")
        value = F.col(name) if name in self.promoted else F.try_element_at(F.col("labels"), F.lit(name))
        return F.coalesce(value, F.lit(""))

    def _chosen(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        d = self.series_rows
        if low is not None:
            d = d.where((F.col("max_time") >= low) & (F.col("min_time") <= high))
        for m in matchers:
            d = d.where(matches(self._label(m.label), m))
        key = L.put(L.from_map(F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>"))), L.NAME, F.coalesce(F.col("metric_name"), F.lit("")))
        for p in self.promoted:
            key = L.put(key, p, F.coalesce(F.col(p), F.lit("")))
        return d.select("id", key.alias("lkey"))

    def scan(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        s = self.sample_rows.where(~F.coalesce(F.col("is_stale"), F.lit(False)))
        if low is not None:
            s = s.where(F.col("ts_ms").between(low, high))
        d = s.join(self._chosen(matchers, low, high), "id")
        return d.select("lkey", F.col("ts_ms").alias("t"), F.coalesce(F.col("value"), F.lit(float("nan"))).alias("value"))

    def series(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        return self._chosen(matchers, low, high).select("lkey").distinct()


@dataclass
class Catalog:
    """Metrics by name, and stores that hold many."""

    spark: SparkSession
    metrics: dict[str, Metric] = field(default_factory=dict)
    stores: list[SeriesStore] = field(default_factory=list)

    def add(self, *metrics: Metric) -> Catalog:
        self.metrics |= {m.name: m for m in metrics}
        return self

    def _parts(self, matchers: Sequence[Matcher]) -> list:
        named = [m for m in matchers if m.label == L.NAME]
        own = [x for x in self.metrics.values() if all(matches_text(x.name, m) for m in named)]
        return [*own, *self.stores]

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scan(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        return self._union([p.scan(matchers, low, high) for p in self._parts(matchers)], "lkey string, t long, value double")

    def series(self, matchers: Sequence[Matcher], low: int | None, high: int | None) -> DataFrame:
        return self._union([p.series(matchers, low, high) for p in self._parts(matchers)], "lkey string").distinct()

    def one_metric(self, matchers: Sequence[Matcher]) -> bool:
        return any(m.label == L.NAME and m.op == "=" for m in matchers)


#: Bits of the NaN that marks the end of a series (a fixed value of the exposition format).
STALE_BITS = 0x7FF0000000000002


def with_stale_flag(samples: DataFrame, value: str = "value") -> DataFrame:
    """Adds is_stale at ingest, as SQL cannot see the bits of a NaN later."""


    @F.pandas_udf("boolean")
    def stale(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(dtype="float64").view("int64") == STALE_BITS)

    return samples.withColumn("is_stale", F.when(F.col(value).isNotNull() & F.isnan(value), stale(F.col(value))).otherwise(F.lit(False)))
