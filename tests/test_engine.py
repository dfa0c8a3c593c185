"""Operators on small series, against values worked out by hand or by a plain Python version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine, render, with_labels
from tidemark.errors import BadData, ExecutionError
from tidemark.functions import labels as L
from tidemark.sources.metrics import Catalog, Metric, SeriesStore, with_stale_flag

NAN, INF = math.nan, math.inf


def metric(spark, name, rows, labels):
    """rows: (label values..., seconds, value)."""
    ddl = ", ".join([*(f"`{n}` string" for n in labels), "t long", "value double"])
    return Metric(name, spark.createDataFrame([(*r[:-2], int(r[-2] * 1000), float(r[-1])) for r in rows], ddl), tuple(labels))


@pytest.fixture(scope="module")
def engine(spark):
    m = metric(spark, "m", [("api", 10, 1), ("api", 20, 2), ("api", 30, 5), ("worker", 10, 3), ("worker", 20, NAN), ("worker", 30, 9)], ["job"])
    c = metric(spark, "c", [("a", 0, 0), ("a", 10, 10), ("a", 20, 20), ("a", 30, 5), ("a", 40, 15)], ["k"])
    h = metric(spark, "h_bucket", [("1", 30, 2), ("2", 30, 6), ("4", 30, 5), ("+Inf", 30, 10), ("bad", 30, 99)], ["le"])
    one = metric(spark, "one", [("x", "1", 30, 4), ("y", "2", 30, 6), ("z", "10", 30, INF)], ["a", "n"])
    info = metric(spark, "target_info", [("api", "i", "eu", 30, 1)], ["job", "instance", "region"])
    up = metric(spark, "up", [("api", "i", 30, 1), ("db", "i", 30, 1)], ["job", "instance"])
    return Engine(Catalog(spark).add(m, c, h, one, info, up))


def values(engine, text, *labels, at=30):
    rows = with_labels(engine.query(text, at), *labels).collect()
    return {r[0] if len(labels) == 1 else tuple(r[: len(labels)]): r["value"] for r in rows}


def same(a, b):
    return a.keys() == b.keys() and all((math.isnan(a[k]) and math.isnan(b[k])) or a[k] == pytest.approx(b[k]) for k in a)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("sum_over_time(m[20s])", {"api": 8, "worker": NAN}),
        ("max_over_time(m[20s])", {"api": 5, "worker": NAN}),
        ("min_over_time(m[20s])", {"api": 1, "worker": NAN}),
        ("count_over_time(m[20s])", {"api": 3, "worker": 3}),
        ("last_over_time(m[20s])", {"api": 5, "worker": 9}),
        ("first_over_time(m[10s])", {"api": 2, "worker": NAN}),
        ("quantile_over_time(0.5, m[20s])", {"api": 2, "worker": 3}),
        ("quantile_over_time(2, m[20s])", {"api": INF, "worker": INF}),
        ("mad_over_time(m[20s])", {"api": 1, "worker": 0}),
        ("changes(m[20s])", {"api": 2, "worker": NAN}),
        ("resets(m[20s])", {"api": 0, "worker": 0}),
        ("idelta(m[20s])", {"api": 3, "worker": NAN}),
        ("deriv(m[20s])", {"api": 0.2, "worker": NAN}),
        ("ts_of_max_over_time(m[20s])", {"api": 30, "worker": 30}),
        ("ts_of_min_over_time(m[20s])", {"api": 10, "worker": 10}),
        ("present_over_time(m[20s])", {"api": 1, "worker": 1}),
        ("m offset 10s", {"api": 2}),
        ("m @ 10", {"api": 1, "worker": 3}),
        ("m > 6", {"worker": 9}),
        ("m > bool 6", {"api": 0, "worker": 1}),
        ("m / 0", {"api": INF, "worker": INF}),
        ("m % 0", {"api": NAN, "worker": NAN}),
        ("0 - m", {"api": -5, "worker": -9}),
        ("ln(m - 5)", {"api": -INF, "worker": math.log(4)}),
        ("sqrt(m - 6)", {"api": NAN, "worker": math.sqrt(3)}),
        ("round(m * 0.5)", {"api": 3, "worker": 5}),
        ("clamp(m, 6, 7)", {"api": 6, "worker": 7}),
        ("clamp(m, 7, 6)", {}),
        ("timestamp(m)", {"api": 30, "worker": 30}),
        ("topk(1, m)", {"worker": 9}),
        ("bottomk(1, m)", {"api": 5}),
        ("limitk(1, m)", {"api": 5}),
        ("m and on (job) up", {"api": 5}),
        ("m unless on (job) up", {"worker": 9}),
        ("m * on (job) up", {"api": 5}),
        ("m - on (job) fill_right (1) up", {"api": 4, "worker": 8}),
        ("max_over_time(m[20s:10s])", {"api": 5, "worker": 9}),
        ("double_exponential_smoothing(m[20s] offset 0s, 0.5, 0.5)", {"api": 4.0, "worker": NAN}),
    ],
)
def test_by_job(engine, text, expected):
    assert same(values(engine, text, "job"), expected)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("sum(m)", 14), ("min(one)", 4), ("max(one)", INF), ("avg(m)", 7), ("count(m)", 2), ("group(m)", 1), ("stddev(m)", 2), ("stdvar(m)", 4), ("quantile(0.5, m)", 7),
        ("vector(1) + vector(2)", 3), ("scalar(sum(m)) * 2", 28), ("scalar(m)", NAN), ("pi() * 0 + time()", 30), ("1 / 0 * 2", INF), ("absent(nothing)", 1), ("absent_over_time(nothing[5m])", 1),
        ("histogram_quantile(0.5, h_bucket)", 1.75), ("histogram_quantile(0.9, h_bucket)", 4), ("histogram_quantile(-1, h_bucket)", -INF), ("histogram_count(h_bucket)", 10), ("histogram_fraction(0, 2, h_bucket)", 0.6),
        ("histogram_sum(h_bucket)", 2 * 0.5 + 4 * 1.5 + 0 * 3 + 4 * 4), ("histogram_avg(h_bucket)", 2.3), ("hour(vector(3700))", 1), ("days_in_month(vector(1709164800))", 29), ("day_of_week(vector(0))", 4),
        ("count(count_values(\"v\", m))", 2), ("sum(limit_ratio(1, m))", 14), ("rate(c[40s])", None),
    ],
)
def test_single_values(engine, text, expected):
    got = [r["value"] for r in engine.query(text, 40 if "rate(" in text else 30).collect()]
    if expected is None:  # 10 + 10 + 5 + 10 over the whole window, nothing to extrapolate
        expected = 35 / 40
    assert len(got) == 1 and (math.isnan(got[0]) and math.isnan(expected) or got[0] == pytest.approx(expected))


def test_counters(engine):
    assert values(engine, "increase(c[40s])", "k", at=40) == {"a": pytest.approx(35)}
    assert values(engine, "irate(c[40s])", "k", at=30) == {"a": 0.5}
    assert values(engine, "resets(c[40s])", "k", at=40) == {"a": 1}
    assert values(engine, "rate(c[5s])", "k", at=40) == {}


def test_labels_functions(engine):
    assert values(engine, 'label_replace(one, "b", "<$1>", "a", "(x|y)")', "a", "b") == {("x", "<x>"): 4, ("y", "<y>"): 6, ("z", ""): INF}
    assert values(engine, 'label_join(one, "b", "-", "a", "none", "n")', "b") == {"x--1": 4, "y--2": 6, "z--10": INF}
    assert values(engine, "info(up)", "job", "region") == {("api", "eu"): 1, ("db", ""): 1}
    assert values(engine, 'info(up, {region="eu"})', "job", "region") == {("api", "eu"): 1}
    order = [r["n"] for r in with_labels(engine.query('sort_by_label(one, "n")', 30), "n").collect()]
    assert order == ["1", "2", "10"]
    assert [r["value"] for r in engine.query("sort_desc(one)", 30).collect()] == [INF, 6, 4]


def test_duplicates_are_errors(engine):
    for text in ('label_replace(m, "job", "x", "job", ".*")', "m + on () m", "m + on () group_left () m"):
        with pytest.raises(Exception, match="duplicate|labelset|unique"):
            engine.query(text, 30).collect()


def test_bad_requests(engine):
    for text in ("nope(m)", "rate(m)", "m[5m] + 1", "topk(m, m)", "sum(1)", "1 > 2", "m and 1", '"text"', "clamp(m, 1)", "double_exponential_smoothing(m[1m], 2, 0.1)", "round(m, 0)"):
        with pytest.raises(BadData):
            engine.query(text, 30)
    for args in ((30, 20, 10), (0, 10, 0), (0, 1e9, 1)):
        with pytest.raises(BadData):
            engine.query_range("m", *args)
    with pytest.raises(BadData):
        engine.query_range("m[5m]", 0, 10, 1)
    with pytest.raises(ExecutionError):
        engine.guard(engine.query("m", 30), 1)


def test_range_and_pinned(engine):
    rows = with_labels(engine.query_range("m", 0, 40, 10), "job").collect()
    assert sorted((r["job"], r["ts_ms"], r["value"]) for r in rows) == [("api", t * 1000, v) for t, v in ((10, 1), (20, 2), (30, 5), (40, 5))] + [("worker", t * 1000, v) for t, v in ((10, 3), (30, 9), (40, 9))]
    pinned = engine.query_range("sum(m @ end())", 0, 40, 20).collect()
    assert sorted((r["ts_ms"], r["value"]) for r in pinned) == [(0, 14), (20_000, 14), (40_000, 14)]


def test_metadata(engine):
    assert {r[0] for r in engine.labels(["m"]).collect()} == {"__name__", "job"}
    assert {r[0] for r in engine.label_values("job").collect()} == {"api", "worker", "db"}
    assert engine.series(["m", "up"]).count() == 4
    assert engine.selector_stats("m") == 2 and engine.selector_stats("m", 1) == 2
    assert "Scan" in engine.explain("sum(m)", 30)["plan"]
    assert Engine.parse("a + 1")["type"] == "binary" and Engine.format("a+1") == "(a) + (1)"
    assert render(engine.query("sum(m)", 30), False)["data"]["result"] == [{"metric": {}, "value": [30.0, "14"]}]


def test_store_and_stale(spark):
    import struct

    stale = struct.unpack("<d", struct.pack("<Q", 0x7FF0000000000002))[0]
    samples = with_stale_flag(spark.createDataFrame([("1", 10_000, 1.0), ("1", 20_000, stale), ("2", 10_000, None), ("2", 20_000, 4.0)], "id string, ts_ms long, value double"))
    series = spark.createDataFrame([("1", "s", {"a": "x"}, "p", 10_000, 20_000), ("2", "s", {"a": "y"}, None, 10_000, 20_000)], "id string, metric_name string, labels map<string,string>, zone string, min_time long, max_time long")
    e = Engine(Catalog(spark, stores=[SeriesStore(series, samples, ("zone",))]))
    assert values(e, 's{zone="p"}', "a", at=20) == {"x": 1}
    assert values(e, "count_over_time(s[20s])", "a", at=20) == {"x": 1, "y": 2}
    assert values(e, 's{a!~"x"}', "a", at=20) == {"y": 4}


def test_label_keys(spark):
    k = L.from_columns({"b": F.lit("2"), "a": F.lit("1"), "c": F.lit(None), "d": F.lit("")})
    row = spark.range(1).select(L.to_map(k), L.get(k, "b"), L.to_map(L.drop(k, ("a",))), L.to_map(L.keep(k, ("a",))), L.to_map(L.put(k, "a", F.lit(""))), L.to_map(L.put(k, "aa", F.lit("9"))), L.to_map(F.lit(""))).first()
    assert list(row) == [{"a": "1", "b": "2"}, "2", {"b": "2"}, {"a": "1"}, {"b": "2"}, {"a": "1", "aa": "9", "b": "2"}, {}]


def test_rate_on_random_series(spark):
    """Against a plain version that looks at each window by itself, over slices of several days."""
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(300):
        t += rng.randint(1, 3000)
        rows.append(("a", t, rng.randint(0, 50)))
    e = Engine(Catalog(spark).add(metric(spark, "r", rows, ["k"])))
    got = {r["ts_ms"] // 1000: r["value"] for r in e.query_range("increase(r[2h])", 7200, t, 7200).collect()}
    want = {}
    for at in range(7200, t + 1, 7200):
        w = [(x, v) for _, x, v in rows if at - 7200 <= x <= at]
        if len(w) < 2:
            continue
        delta = w[-1][1] - w[0][1] + sum(a[1] for a, b in zip(w, w[1:], strict=False) if b[1] < a[1])
        length, gap = w[-1][0] - w[0][0], (w[-1][0] - w[0][0]) / (len(w) - 1)
        begin, end = w[0][0] - (at - 7200), at - w[-1][0]
        if delta > 0 and length * w[0][1] / delta < begin:
            begin = length * w[0][1] / delta
        want[at] = delta * (length + (gap / 2 if begin >= 1.1 * gap else begin) + (gap / 2 if end >= 1.1 * gap else end)) / length
    assert got == pytest.approx(want)
