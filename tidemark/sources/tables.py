"""Metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .metrics import Catalog, Metric, SeriesStore, within

#: Bucket bounds of events_value_bucket (fixed values).
BOUNDS = (10.0, 25.0, 50.0, 75.0, 100.0, 250.0)
DAY, HOUR = 86_400_000, 3_600_000


def millis(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def _plus(ms: int | None, by: int) -> int | None:
    return None if ms is None else ms + by


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gauge(spark: SparkSession, sf_dir: str) -> Metric:
    """events_value{event_type, user_id}; of samples at one millisecond the highest event_id counts."""
    e = read(spark, sf_dir, "events").withColumn("t", millis("ts"))
    rows = e.select("ts", "t", "event_type", F.col("user_id").cast("string").alias("user_id"), "value")
    return Metric("events_value", rows, ("event_type", "user_id"), bound="ts")


def by_type(spark: SparkSession, sf_dir: str) -> Metric:
    """events_type_value{event_type}: all users' values of a type as one series."""


    def rows(low: int | None, high: int | None) -> DataFrame:
        e = within(read(spark, sf_dir, "events"), "ts", low, high).withColumn("t", millis("ts"))
        return e.groupBy("event_type", "t").agg(F.max_by("value", "event_id").alias("value"))

    return Metric("events_type_value", rows, ("event_type",))


def counter(spark: SparkSession, sf_dir: str, slice_ms: int = DAY) -> Metric:
    """events_total{event_type}: running number of events. Counts run within a day; days before add up
    as one row each, so that no task sorts a whole type. Only events after the upper bound can be left out."""

    def rows(low: int | None, high: int | None) -> DataFrame:
        e = within(read(spark, sf_dir, "events"), "ts", None, high).select("event_type", millis("ts").alias("t"))
        at = e.groupBy("event_type", "t").agg(F.count("*").alias("c")).withColumn("d", F.floor(F.col("t") / slice_ms))
        days = at.groupBy("event_type", "d").agg(F.sum("c").alias("dc"))
        before = Window.partitionBy("event_type").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        days = days.select("event_type", "d", F.coalesce(F.sum("dc").over(before), F.lit(0)).alias("base"))
        so_far = Window.partitionBy("event_type", "d").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = at.withColumn("n", F.sum("c").over(so_far)).join(days, ["event_type", "d"])
        return counts.select("event_type", "t", (F.col("n") + F.col("base")).cast("double").alias("value"))

    return Metric("events_total", rows, ("event_type",))


def buckets(spark: SparkSession, sf_dir: str) -> Metric:
    """events_value_bucket{event_type, le}: hourly counts of values up to each bound, at the hour's end."""
    bounds = [*((b, str(int(b))) for b in BOUNDS), (float("inf"), "+Inf")]

    def rows(low: int | None, high: int | None) -> DataFrame:
        e = within(read(spark, sf_dir, "events"), "ts", _plus(low, -HOUR), high)
        e = e.select("event_type", "value", ((F.floor(millis("ts") / HOUR) + 1) * HOUR).alias("t"))
        # one count for each bound, so that no event is copied; the few results are spread
        counts = e.groupBy("event_type", "t").agg(*(F.count_if(F.col("value") <= b).cast("double").alias(f"c{i}") for i, (b, _) in enumerate(bounds)))
        each = F.array(*(F.struct(F.lit(le).alias("le"), F.col(f"c{i}").alias("value")) for i, (_, le) in enumerate(bounds)))
        return counts.select("event_type", "t", F.explode(each).alias("x")).select("event_type", "t", "x.le", "x.value")

    return Metric("events_value_bucket", rows, ("event_type", "le"))


def _daily(spark: SparkSession, sf_dir: str, table: str, ts: str, name: str, labels: dict[str, str], value) -> Metric:
    def rows(low: int | None, high: int | None) -> DataFrame:
        d = within(read(spark, sf_dir, table), ts, low, _plus(high, DAY))
        d = d.select(*(F.col(c).alias(n) for n, c in labels.items()), value.alias("v"), (F.floor(millis(ts) / DAY) * DAY).alias("t"))
        return d.groupBy(*labels, "t").agg(F.sum("v").alias("value"))

    return Metric(name, rows, tuple(labels))


def quantity(spark: SparkSession, sf_dir: str) -> Metric:
    """lineitem_quantity_total{returnflag, linestatus}: running daily sums by ship date."""
    d = _daily(spark, sf_dir, "lineitem", "l_shipdate", "lineitem_quantity_total", {"returnflag": "l_returnflag", "linestatus": "l_linestatus"}, F.col("l_quantity"))
    w = Window.partitionBy("returnflag", "linestatus").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return Metric(d.name, lambda low, high: d.table(None, high).withColumn("value", F.sum("value").over(w)), d.labels)


def prices(spark: SparkSession, sf_dir: str) -> Metric:
    """orders_price{orderstatus, orderpriority}: daily sums by order date."""
    return _daily(spark, sf_dir, "orders", "o_orderdate", "orders_price", {"orderstatus": "o_orderstatus", "orderpriority": "o_orderpriority"}, F.round("o_totalprice", 2).cast("decimal(18,2)"))


def orders_count(spark: SparkSession, sf_dir: str) -> Metric:
    """orders_count{orderstatus, orderpriority}: orders a day."""
    return _daily(spark, sf_dir, "orders", "o_orderdate", "orders_count", {"orderstatus": "o_orderstatus", "orderpriority": "o_orderpriority"}, F.lit(1))


def balances(spark: SparkSession, sf_dir: str) -> Metric:
    """supplier_balance{job, instance}: account balances summed by nation, at time 0."""
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.groupBy(F.col("n_name").alias("instance")).agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("value")).select("instance", F.lit("tpch").alias("job"), F.lit(0).cast("long").alias("t"), "value")
    return Metric("supplier_balance", rows, ("job", "instance"))


def target_info(spark: SparkSession, sf_dir: str) -> Metric:
    """target_info{job, instance, region}: one for each nation, at time 0."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.lit("tpch").alias("job"), F.col("n_name").alias("instance"), F.col("r_name").alias("region"), F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("value"))
    return Metric("target_info", rows, ("job", "instance", "region"))


def event_store(spark: SparkSession, sf_dir: str) -> SeriesStore:
    """The events by type as a series/samples pair."""
    m = by_type(spark, sf_dir)
    series = m.table().groupBy("event_type").agg(F.min("t").alias("min_time"), F.max("t").alias("max_time"))
    series = series.select(F.col("event_type").alias("id"), F.lit("stored_value").alias("metric_name"), F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), "min_time", "max_time")
    samples = m.table().select(F.col("event_type").alias("id"), F.col("t").alias("ts_ms"), "value", F.lit(False).alias("is_stale"))
    return SeriesStore(series, samples)


ALL = {"events_value": gauge, "events_type_value": by_type, "events_total": counter, "events_value_bucket": buckets, "lineitem_quantity_total": quantity, "orders_price": prices, "orders_count": orders_count, "supplier_balance": balances, "target_info": target_info}


def catalog(spark: SparkSession, sf_dir: str, *names: str, stored: bool = False) -> Catalog:
    """The metrics of these names, or all."""
    out = Catalog(spark).add(*(ALL[n](spark, sf_dir) for n in names or ALL))
    if stored:
        out.stores.append(event_store(spark, sf_dir))
    return out
