"""Registered queries: each names its metrics, query text and labels, and the SQL that must agree.

Results have a column for each label, ts_ms and the value, rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, with_labels
from .plans.rules import Rules
from .sources.tables import BOUNDS, catalog

#: The range queries span all events: 2024-01-01 06:00, whose windows reach the first, to 2024-01-31 06:00.
START, END, STEP = 1704088800000, 1706680800000, 43_200_000
#: Time of the instant queries, and bounds of a bounded list of series.
INSTANT, BOUNDED = 1704412800000, (1704412800000, 1705276800000)
LOOKBACK = 86_400_000
DAY = 86_400_000
#: Days of the long tables, from the first order in 1995 to the last shipping date in 2001.
LONG_START, LONG_END = 788_918_400_000, 1_004_832_000_000

SAMPLES = {
    "events_value": "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v FROM events",
    "events_type_value": "SELECT event_type, epoch_us(ts) // 1000 AS t, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2",
    "events_total": "SELECT event_type, t, CAST(sum(c) OVER (PARTITION BY event_type ORDER BY t) AS DOUBLE) AS v FROM (SELECT event_type, epoch_us(ts) // 1000 AS t, count(*) AS c FROM events GROUP BY 1, 2)",
    "events_value_bucket": "SELECT event_type, t, b, CASE WHEN isinf(b) THEN '+Inf' ELSE CAST(CAST(b AS BIGINT) AS VARCHAR) END AS le, CAST(sum(CASE WHEN value <= b THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM (SELECT event_type, value, (epoch_us(ts) // 3600000000 + 1) * 3600000 AS t, unnest([" + ", ".join(map(str, BOUNDS)) + ", CAST('Infinity' AS DOUBLE)]) AS b FROM events) GROUP BY 1, 2, 3",
    "lineitem_quantity_total": "SELECT returnflag, linestatus, t, sum(q) OVER (PARTITION BY returnflag, linestatus ORDER BY t) AS v FROM (SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, epoch_us(l_shipdate) // 86400000000 * 86400000 AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)",
    "orders_price": "SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, epoch_us(o_orderdate) // 86400000000 * 86400000 AS t, CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3",
    "orders_count": "SELECT o_orderstatus AS orderstatus, o_orderpriority AS orderpriority, epoch_us(o_orderdate) // 86400000000 * 86400000 AS t, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3",
    "supplier_balance": "SELECT 'tpch' AS job, n_name AS instance, 0 AS t, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
    "target_info": "SELECT 'tpch' AS job, n_name AS instance, r_name AS region, 0 AS t, 1.0 AS v FROM nation JOIN region ON n_regionkey = r_regionkey",
}
LABELS = {"events_value": "event_type, user_id", "events_total": "event_type", "events_type_value": "event_type", "events_value_bucket": "event_type, le, b", "lineitem_quantity_total": "returnflag, linestatus", "orders_price": "orderstatus, orderpriority", "orders_count": "orderstatus, orderpriority", "supplier_balance": "job, instance", "target_info": "job, instance, region"}


@dataclass(frozen=True)
class Query:
    text: str
    metrics: tuple[str, ...]
    labels: tuple[str, ...]
    sql: str | None
    start: int = START
    end: int = END
    step: int = STEP
    instant: bool = False
    digits: int = 6
    rules: tuple[tuple[str, str], ...] = ()
    stored: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = Rules()
        for record, expr in self.rules:
            rules.add(record, expr)
        e = Engine(catalog(spark, sf_dir, *self.metrics, stored=self.stored), rules, LOOKBACK / 1000)
        rows = e.query(self.text, self.start / 1000) if self.instant else e.query_range(self.text, self.start / 1000, self.end / 1000, self.step / 1000)
        return with_labels(rows, *self.labels).withColumn("value", F.round("value", self.digits) + F.lit(0.0))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        ctes = ", ".join(f"{m} AS ({SAMPLES[m]})" for m in self.metrics)
        grid = f"grid AS (SELECT unnest(range({self.start}, {self.start if self.instant else self.end} + 1, {self.step})) AS ts)"
        columns = ", ".join((*self.labels, "CAST(ts AS BIGINT) AS ts_ms", f"round(CAST(v AS DOUBLE), {self.digits}) + 0.0 AS value"))
        return f"WITH {grid}, {ctes} SELECT {columns} FROM ({self.sql})"


def iv(metric: str, where: str = "true", offset: int = 0, back: int = LOOKBACK) -> str:
    """SQL of an instant selector: labels, ts, v and the sample's time st."""
    return f"(SELECT {LABELS[metric]}, ts, arg_max(v, t) AS v, max(t) AS st FROM {metric} JOIN grid ON t BETWEEN ts - {offset} - {back} AND ts - {offset} WHERE {where} GROUP BY {LABELS[metric]}, ts)"


def win(metric: str, span: int = DAY, offset: int = 0) -> str:
    """SQL of a windowed range selector, with each sample's predecessor in the series."""
    return f"(SELECT * FROM (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM {metric} WINDOW w AS (PARTITION BY {LABELS[metric]} ORDER BY t)) JOIN grid ON t BETWEEN ts - {offset} - {span} AND ts - {offset})"


def over(metric: str, value: str, span: int = DAY, having: str = "true") -> str:
    return f"SELECT {LABELS[metric]}, ts, {value} AS v FROM {win(metric, span)} GROUP BY {LABELS[metric]}, ts HAVING {having}"


def rate(metric: str, span: int = DAY, per_second: bool = True, counter: bool = True) -> str:
    """SQL of the extrapolated change over windows."""
    drops = f"sum(CASE WHEN pt >= ts - {span} AND v < pv THEN pv ELSE 0 END)" if counter else "0"
    inner = f"SELECT {LABELS[metric]}, ts, count(*) AS n, min(t) AS a, max(t) AS b, arg_min(v, t) AS v0, arg_max(v, t) - arg_min(v, t) + {drops} AS d FROM {win(metric, span)} GROUP BY {LABELS[metric]}, ts HAVING count(*) >= 2"
    start = "CASE WHEN d > 0 AND v0 >= 0 AND (b - a) / 1000.0 * v0 / d < (a - (ts - SPAN)) / 1000.0 THEN (b - a) / 1000.0 * v0 / d ELSE (a - (ts - SPAN)) / 1000.0 END" if counter else "(a - (ts - SPAN)) / 1000.0"
    gaps = f"SELECT *, (b - a) / 1000.0 AS len, (b - a) / 1000.0 / (n - 1) AS gap, {start.replace('SPAN', str(span))} AS ds, (ts - b) / 1000.0 AS de FROM ({inner})"
    out = "d * ((len + CASE WHEN ds >= gap * 1.1 THEN gap / 2 ELSE ds END + CASE WHEN de >= gap * 1.1 THEN gap / 2 ELSE de END) / len)"
    return f"SELECT {LABELS[metric]}, ts, {out}{f' / {span / 1000}' if per_second else ''} AS v FROM ({gaps})"


V, C, B, O, N, Q = "events_type_value", "events_total", "events_value_bucket", "orders_price", "orders_count", "lineitem_quantity_total"
ET, OS = ("event_type",), ("orderstatus", "orderpriority")
LONG = {"start": LONG_START, "end": LONG_END, "step": DAY}
REGISTERED: dict[str, Query] = {}


def q(name: str, text: str, metrics: str | tuple[str, ...], labels: tuple[str, ...], sql: str | None, **more) -> None:
    if more.get("instant"):
        more.setdefault("start", INSTANT)
    REGISTERED[name] = Query(text, (metrics,) if isinstance(metrics, str) else metrics, labels, sql, **more)


# selectors, matchers and modifiers
q("selector_instant", V, V, ET, f"SELECT event_type, st AS ts, v FROM {iv(V)}", instant=True)
q("selector_grid", V, V, ET, f"SELECT * FROM {iv(V)}")
q("selector_users", "events_value", "events_value", ("event_type", "user_id"), None)
q("selector_range", f"{V}[1d]", V, ET, f"SELECT event_type, t AS ts, v FROM {win(V)}", instant=True)
q("matcher_equal", V + '{event_type="click"}', V, ET, f"SELECT * FROM {iv(V, "event_type = 'click'")}")
q("matcher_not_equal", V + '{event_type!="click"}', V, ET, f"SELECT * FROM {iv(V, "event_type <> 'click'")}")
q("matcher_regex", V + '{event_type=~"p.*|view"}', V, ET, f"SELECT * FROM {iv(V, "regexp_full_match(event_type, 'p.*|view')")}")
q("matcher_not_regex", V + '{event_type!~"p.*"}', V, ET, f"SELECT * FROM {iv(V, "NOT regexp_full_match(event_type, 'p.*')")}")
q("matcher_absent_label", V + '{host=""}', V, ET, f"SELECT * FROM {iv(V)}")
q("matcher_name_regex", '{__name__=~"orders_(price|count)"}', (O, N), OS, f"SELECT * FROM (SELECT {LABELS[O]}, ts, v FROM {iv(O)} UNION ALL SELECT {LABELS[N]}, ts, v FROM {iv(N)})", **LONG)
q("offset", f"{V} offset 6h", V, ET, f"SELECT * FROM {iv(V, offset=21_600_000)}")
q("offset_negative", f"{V} offset -6h", V, ET, f"SELECT * FROM {iv(V, offset=-21_600_000)}")
q("at_end", f"{V} @ end()", V, ET, f"SELECT event_type, g.ts, x.v FROM {iv(V)} x, grid g WHERE x.ts = {END}")
q("at_start", f"{V} @ start()", V, ET, f"SELECT event_type, g.ts, x.v FROM {iv(V)} x, grid g WHERE x.ts = {START}")
q("at_time", f"{V} @ {START / 1000 + 86400:.0f}", V, ET, f"SELECT event_type, g.ts, x.v FROM {iv(V)} x, grid g WHERE x.ts = {START + DAY}")
q("series_store", "stored_value", V, ET, f"SELECT * FROM {iv(V)}", stored=True)

# range-vector functions
for _name, _sql in {
    "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)",
    "present": "1", "last": "arg_max(v, t)", "first": "arg_min(v, t)", "mad": "mad(v)", "ts_of_first": "min(t) / 1000.0", "ts_of_last": "max(t) / 1000.0",
    "ts_of_max": "CAST(arg_max(t, v * 1e14 + t / 1000.0) AS DOUBLE) / 1000.0", "ts_of_min": "CAST(arg_min(t, v * 1e14 - t / 1000.0) AS DOUBLE) / 1000.0",
}.items():
    q(f"{_name}_over_time", f"{_name}_over_time({V}[1d])", V, ET, None if _name.startswith("ts_of_m") else over(V, _sql), digits=3 if "ts_of" in _name else 9 if _name == "avg" else 6)
for _best, _order in (("max", "v DESC, t DESC"), ("min", "v, t DESC")):
    q(f"ts_of_{_best}_over_time", f"ts_of_{_best}_over_time({V}[1d])", V, ET, f"SELECT event_type, ts, t / 1000.0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY {_order}) AS r FROM {win(V)}) WHERE r = 1", digits=3)
q("quantile_over_time", f"quantile_over_time(0.9, {V}[1d])", V, ET, over(V, "quantile_cont(v, 0.9)"))
q("rate", f"rate({C}[1d])", C, ET, rate(C), digits=9)
q("increase", f"increase({C}[1d])", C, ET, rate(C, per_second=False))
q("delta", f"delta({V}[1d])", V, ET, rate(V, per_second=False, counter=False))
q("rate_with_resets", f"rate({V}[1d])", V, ET, rate(V), digits=9)
_last = f"(SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY t DESC) AS r, count(*) OVER (PARTITION BY event_type, ts) AS n FROM {win(V)})"
q("irate", f"irate({V}[1d])", V, ET, f"SELECT event_type, ts, (CASE WHEN v < pv THEN v ELSE v - pv END) / ((t - pt) / 1000.0) AS v FROM {_last} WHERE r = 1 AND n >= 2", digits=9)
q("idelta", f"idelta({V}[1d])", V, ET, f"SELECT event_type, ts, v - pv AS v FROM {_last} WHERE r = 1 AND n >= 2")
q("deriv", f"deriv({V}[1d])", V, ET, over(V, "regr_slope(v, (t - ts) / 1000.0)", having="count(*) >= 2"), digits=9)
q("predict_linear", f"predict_linear({V}[1d], 4 * 3600)", V, ET, over(V, "regr_slope(v, (t - ts) / 1000.0) * 14400 + regr_intercept(v, (t - ts) / 1000.0)", having="count(*) >= 2"), digits=4)
q("changes", f"changes({V}[1d])", V, ET, over(V, f"sum(CASE WHEN pt >= ts - {DAY} AND v <> pv THEN 1 ELSE 0 END)"))
q("resets", f"resets({V}[1d])", V, ET, over(V, f"sum(CASE WHEN pt >= ts - {DAY} AND v < pv THEN 1 ELSE 0 END)"))
q("double_exponential_smoothing", f"double_exponential_smoothing({V}[1d], 0.3, 0.6)", V, ET, None)
q("holt_winters", f"holt_winters({V}[1d], 0.5, 0.5)", V, ET, None)
q("range_offset", f"sum_over_time({V}[6h] offset 1d)", V, ET, f"SELECT event_type, ts, sum(v) AS v FROM {win(V, 21_600_000, DAY)} GROUP BY 1, 2", step=21_600_000, end=END + DAY)
q("range_overlapping", f"max_over_time({V}[3d])", V, ET, over(V, "max(v)", 3 * DAY), step=3_600_000)
q("rate_daily_quantity", f"rate({Q}[7d])", Q, ("returnflag", "linestatus"), rate(Q, 7 * DAY), **LONG)

# aggregations
for _op, _sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "group": "1"}.items():
    q(f"agg_{_op}", f"{_op} by (event_type) (events_value)", "events_value", ET, f"SELECT event_type, ts, {_sql} AS v FROM {iv('events_value')} GROUP BY 1, 2", digits=9 if _op == "avg" else 4)
q("agg_quantile", f"quantile(0.75, {V})", V, (), f"SELECT ts, quantile_cont(v, 0.75) AS v FROM {iv(V)} GROUP BY 1")
q("agg_without", f"sum without (orderpriority) ({O})", O, ("orderstatus",), f"SELECT orderstatus, ts, sum(v) AS v FROM {iv(O)} GROUP BY 1, 2", digits=2, **LONG)
q("agg_all", f"sum({V})", V, (), f"SELECT ts, sum(v) AS v FROM {iv(V)} GROUP BY 1")
q("sum_by_rate_range", f"sum by (event_type) (rate({C}[6h]))", C, ET, f"SELECT event_type, ts, sum(v) AS v FROM ({rate(C, 21_600_000)}) GROUP BY 1, 2", digits=9, step=3_600_000)


def _top(order: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY {order}) AS r FROM {iv(V)}) WHERE r <= {k}"


q("topk", f"topk(2, {V})", V, ET, _top("v DESC, event_type", 2))
q("bottomk", f"bottomk(2, {V})", V, ET, _top("v, event_type", 2))
q("limitk", f"limitk(3, {V})", V, ET, _top("event_type", 3))
q("topk_by", f"topk by (orderstatus) (1, {O})", O, OS, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts, orderstatus ORDER BY v DESC, orderpriority) AS r FROM {iv(O)}) WHERE r = 1", digits=2, **LONG)
q("limit_ratio", 'limit_ratio(0.5, events_value) or limit_ratio(-0.5, events_value)', "events_value", ("event_type", "user_id"), None)
q("count_values", f'count_values("n", {N})', N, ("n",), f"SELECT CAST(CAST(v AS BIGINT) AS VARCHAR) AS n, ts, count(*) AS v FROM {iv(N)} GROUP BY 1, 2", **LONG)
q("sum_or_zero", f'sum({V}{{event_type="none"}}) or vector(0)', V, (), "SELECT ts, 0 AS v FROM grid")

# operators with scalars
for _name, _op, _sql in (("add", "+ 7", "v + 7"), ("sub", "- 7", "v - 7"), ("mul", "* 3", "v * 3"), ("div", "/ 4", "v / 4.0"), ("mod", "% 7", "fmod(v, 7)"), ("pow", "^ 2", "v * v")):
    q(f"binop_{_name}", f"{V} {_op}", V, ET, f"SELECT event_type, ts, {_sql} AS v FROM {iv(V)}", digits=4)
for _name, _op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _duck = {"==": "=", "!=": "<>"}.get(_op, _op)
    q(f"cmp_{_name}", f"{N} {_op} 2", N, OS, f"SELECT * FROM {iv(N, 'true')} WHERE v {_duck} 2", **LONG)
    q(f"cmp_{_name}_bool", f"{N} {_op} bool 2", N, OS, f"SELECT {LABELS[N]}, ts, CASE WHEN v {_duck} 2 THEN 1 ELSE 0 END AS v FROM {iv(N)}", **LONG)
q("scalar_left", f"100 - {V}", V, ET, f"SELECT event_type, ts, 100 - v AS v FROM {iv(V)}")
q("scalar_compare_left", f"50 < {V}", V, ET, f"SELECT * FROM {iv(V)} WHERE 50 < v")
q("unary_minus", f"-{V}", V, ET, f"SELECT event_type, ts, -v AS v FROM {iv(V)}")
q("scalar_literal", "2 ^ 3 ^ 2 - 1", V, (), "SELECT ts, 511 AS v FROM grid")
q("scalar_time", "time() / 60", V, (), "SELECT ts, ts / 60000.0 AS v FROM grid")
q("scalar_pi", "pi() * 2", V, (), "SELECT ts, 2 * pi() AS v FROM grid")
q("scalar_series", f"{V} - scalar(max({V}))", V, ET, f"SELECT event_type, ts, v - max(v) OVER (PARTITION BY ts) AS v FROM {iv(V)}")
q("scalar_of_vector", f'scalar({V}{{event_type="click"}}) + 0', V, (), f"SELECT g.ts, coalesce(x.v, 'NaN'::DOUBLE) AS v FROM grid g LEFT JOIN {iv(V, "event_type = 'click'")} x USING (ts)")
q("vector_of_scalar", "vector(time())", V, (), "SELECT ts, ts / 1000.0 AS v FROM grid", digits=3)

# vector matching
_pair = f"{iv(O)} a JOIN {iv(N)} b USING (orderstatus, orderpriority, ts)"
q("match_one_to_one", f"{O} / {N}", (O, N), OS, f"SELECT orderstatus, orderpriority, ts, a.v / b.v AS v FROM {_pair}", digits=4, **LONG)
q("match_on", f"sum by (orderstatus) ({O}) / on (orderstatus) sum by (orderstatus) ({N})", (O, N), ("orderstatus",), f"SELECT orderstatus, ts, sum(a.v) / sum(b.v) AS v FROM {_pair} GROUP BY 1, 2", digits=4, **LONG)
q("match_ignoring", f'{O}{{orderpriority="1-URGENT"}} - ignoring (orderpriority) {O}{{orderpriority="5-LOW"}}', O, ("orderstatus",), f"SELECT orderstatus, ts, a.v - b.v AS v FROM {iv(O, "orderpriority = '1-URGENT'")} a JOIN {iv(O, "orderpriority = '5-LOW'")} b USING (orderstatus, ts)", digits=2, **LONG)
q("match_group_left", f"{O} / on (orderstatus) group_left () sum by (orderstatus) ({O})", O, OS, f"SELECT orderstatus, orderpriority, ts, v / sum(v) OVER (PARTITION BY orderstatus, ts) AS v FROM {iv(O)}", **LONG)
q("match_group_right", f"sum by (orderstatus) ({O}) - on (orderstatus) group_right () {O}", O, OS, f"SELECT orderstatus, orderpriority, ts, sum(v) OVER (PARTITION BY orderstatus, ts) - v AS v FROM {iv(O)}", digits=2, **LONG)
q("match_group_left_labels", "supplier_balance * on (job, instance) group_left (region) target_info", ("supplier_balance", "target_info"), ("job", "instance", "region"), f"SELECT job, instance, region, ts, a.v * b.v AS v FROM {iv('supplier_balance')} a JOIN {iv('target_info')} b USING (job, instance, ts)", start=0, end=0, digits=2)
q("match_filter", f"{O} > {N} * 100000", (O, N), OS, f"SELECT orderstatus, orderpriority, ts, a.v FROM {_pair} WHERE a.v > b.v * 100000", digits=2, **LONG)
q("match_bool", f"{O} > bool {N} * 100000", (O, N), OS, f"SELECT orderstatus, orderpriority, ts, CASE WHEN a.v > b.v * 100000 THEN 1 ELSE 0 END AS v FROM {_pair}", **LONG)
_fills = f'{N}{{orderpriority="1-URGENT"}} - ignoring (orderpriority) {{fill}} {N}{{orderpriority="5-LOW"}}'
for _name, _how, _l, _r in (("fill", "FULL", "coalesce(a.v, 0)", "coalesce(b.v, 0)"), ("fill_left", "RIGHT", "coalesce(a.v, 0)", "b.v"), ("fill_right", "LEFT", "a.v", "coalesce(b.v, 0)")):
    q(f"match_{_name}", _fills.replace("{fill}", f"{_name} (0)").replace("{{", "{").replace("}}", "}"), N, ("orderstatus",), f"SELECT orderstatus, ts, {_l} - {_r} AS v FROM {iv(N, "orderpriority = '1-URGENT'")} a {_how} JOIN {iv(N, "orderpriority = '5-LOW'")} b USING (orderstatus, ts)", **LONG)
q("match_self", f"{V} + {V}", V, ET, f"SELECT event_type, ts, v + v AS v FROM {iv(V)}")
q("set_and", f"{O} and on (orderstatus, orderpriority) {N} > 2", (O, N), OS, f"SELECT orderstatus, orderpriority, ts, a.v FROM {_pair} WHERE b.v > 2", digits=2, **LONG)
q("set_unless", f"{O} unless {N} > 2", (O, N), OS, f"SELECT orderstatus, orderpriority, ts, a.v FROM {_pair} WHERE b.v <= 2", digits=2, **LONG)
q("set_or", f"{N} > 2 or {N} * 10", N, OS, f"SELECT orderstatus, orderpriority, ts, CASE WHEN v > 2 THEN v ELSE v * 10 END AS v FROM {iv(N)}", **LONG)
q("info", "info(supplier_balance)", ("supplier_balance", "target_info"), ("job", "instance", "region"), f"SELECT job, instance, region, ts, a.v AS v FROM {iv('supplier_balance')} a JOIN {iv('target_info')} b USING (job, instance, ts)", start=0, end=0, digits=2)
q("info_filtered", 'info(supplier_balance, {region=~"A.*"})', ("supplier_balance", "target_info"), ("job", "instance", "region"), f"SELECT job, instance, region, ts, a.v AS v FROM {iv('supplier_balance')} a JOIN {iv('target_info')} b USING (job, instance, ts) WHERE region LIKE 'A%'", start=0, end=0, digits=2)

# functions of a value
for _name, _text, _sql in (
    ("abs", f"abs({V} - 50)", "abs(v - 50)"), ("sgn", f"sgn({V} - 50)", "sign(v - 50)"), ("ceil", f"ceil({V})", "ceil(v)"), ("floor", f"floor({V})", "floor(v)"),
    ("exp", f"exp({V} / 100)", "exp(v / 100)"), ("ln", f"ln({V} + 1)", "ln(v + 1)"), ("log2", f"log2({V} + 1)", "log2(v + 1)"), ("log10", f"log10({V} + 1)", "log10(v + 1)"), ("sqrt", f"sqrt({V})", "sqrt(v)"),
    ("sin", f"sin({V})", "sin(v)"), ("cos", f"cos({V})", "cos(v)"), ("tan", f"tan({V} / 1000)", "tan(v / 1000)"), ("asin", f"asin({V} / 1000)", "asin(v / 1000)"), ("acos", f"acos({V} / 1000)", "acos(v / 1000)"), ("atan", f"atan({V})", "atan(v)"),
    ("sinh", f"sinh({V} / 100)", "sinh(v / 100)"), ("cosh", f"cosh({V} / 100)", "cosh(v / 100)"), ("tanh", f"tanh({V} / 100)", "tanh(v / 100)"), ("asinh", f"asinh({V})", "asinh(v)"), ("acosh", f"acosh({V} + 1)", "acosh(v + 1)"), ("atanh", f"atanh({V} / 1000)", "atanh(v / 1000)"),
    ("deg", f"deg({V})", "v * 180 / pi()"), ("rad", f"rad({V})", "v * pi() / 180"),
    ("clamp", f"clamp({V}, 20, 60)", "greatest(20, least(60, v))"), ("clamp_min", f"clamp_min({V}, 30)", "greatest(v, 30)"), ("clamp_max", f"clamp_max({V}, 30)", "least(v, 30)"), ("round", f"round({V})", "floor(v + 0.5)"), ("round_to", f"round({V}, 5)", "floor(v / 5 + 0.5) * 5"),
):
    q(f"math_{_name}", _text, V, ET, f"SELECT event_type, ts, {_sql} AS v FROM {iv(V)}", digits=5)
q("timestamp", f"timestamp({V})", V, ET, f"SELECT event_type, ts, st / 1000.0 AS v FROM {iv(V)}", digits=3)
for _name, _sql in {"minute": "minute(x)", "hour": "hour(x)", "day_of_week": "dayofweek(x)", "day_of_month": "day(x)", "day_of_year": "dayofyear(x)", "days_in_month": "day(last_day(x))", "month": "month(x)", "year": "year(x)"}.items():
    q(f"date_{_name}", f"{_name}(timestamp({V}))", V, ET, f"SELECT event_type, ts, {_sql} AS v FROM (SELECT *, make_timestamp(st // 1000 * 1000000) AS x FROM {iv(V)})")
q("date_of_grid", "hour() + minute() / 60", V, (), "SELECT ts, hour(make_timestamp(ts * 1000)) + minute(make_timestamp(ts * 1000)) / 60.0 AS v FROM grid")
q("absent", f'absent({V}{{event_type="none"}})', V, ET, "SELECT 'none' AS event_type, ts, 1 AS v FROM grid")
q("absent_present", f"absent({V})", V, (), f"SELECT ts, 1 AS v FROM grid WHERE ts NOT IN (SELECT ts FROM {iv(V)})")
q("absent_over_time", f'absent_over_time({N}{{orderstatus="P",orderpriority="5-LOW"}}[1d])', N, OS, f"SELECT 'P' AS orderstatus, '5-LOW' AS orderpriority, ts, 1 AS v FROM grid WHERE ts NOT IN (SELECT ts FROM {win(N)} WHERE orderstatus = 'P' AND orderpriority = '5-LOW')", **LONG)
q("label_replace", f'label_replace({V}, "kind", "$2-${{1}}", "event_type", "(.)(.*)")', V, ("event_type", "kind"), f"SELECT event_type, substr(event_type, 2) || '-' || substr(event_type, 1, 1) AS kind, ts, v FROM {iv(V)}")
q("label_join", f'label_join({O}, "pair", "/", "orderstatus", "orderpriority")', O, ("pair",), f"SELECT orderstatus || '/' || orderpriority AS pair, ts, v FROM {iv(O)}", digits=2, **LONG)
for _name in ("sort", "sort_desc"):
    q(_name, f"{_name}({V})", V, ET, f"SELECT * FROM {iv(V)}", instant=True)
for _name in ("sort_by_label", "sort_by_label_desc"):
    q(_name, f'{_name}({V}, "event_type")', V, ET, f"SELECT * FROM {iv(V)}", instant=True)

# classic histograms: the events of the last hour with any
_seg = f"(SELECT event_type, ts, b AS up, v AS c, coalesce(lag(b) OVER w, 0) AS lo, coalesce(lag(v) OVER w, 0) AS prev, max(v) OVER (PARTITION BY event_type, ts) AS total, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_type, ts) AS n FROM {iv(B)} WINDOW w AS (PARTITION BY event_type, ts ORDER BY b))"


def _hq(phi: float) -> str:
    pick = f"SELECT event_type, ts, arg_min(CASE WHEN isinf(up) THEN lo WHEN c <= prev THEN 'NaN'::DOUBLE ELSE lo + (up - lo) * (({phi} * total - prev) / (c - prev)) END, i) AS v FROM {_seg} WHERE total > 0 AND (c >= {phi} * total OR isinf(up)) GROUP BY 1, 2"
    return pick


def _below(x: float) -> str:
    return f"arg_min(CASE WHEN up <= {x} THEN NULL WHEN lo >= {x} OR isinf(up) THEN prev ELSE prev + (c - prev) * ({x} - lo) / (up - lo) END, i) FILTER (WHERE up > {x})"


_mid = "(CASE WHEN isinf(up) THEN lo ELSE lo + (up - lo) / 2 END)"
_sum = f"sum((c - prev) * {_mid})"
_mean = f"(SELECT *, sum((c - prev) * {_mid}) OVER (PARTITION BY event_type, ts) / total AS mean FROM {_seg} WHERE total > 0)"
_var = f"sum((c - prev) * ({_mid} - mean) * ({_mid} - mean)) / max(total)"
q("histogram_quantile", f"histogram_quantile(0.9, {B})", B, ET, _hq(0.9))
q("histogram_quantiles", f'histogram_quantiles({B}, "q", 0.5, 0.95)', B, ("event_type", "q"), f"SELECT event_type, '0.5' AS q, ts, v FROM ({_hq(0.5)}) UNION ALL SELECT event_type, '0.95' AS q, ts, v FROM ({_hq(0.95)})")
q("histogram_fraction", f"histogram_fraction(20, 80, {B})", B, ET, f"SELECT event_type, ts, ({_below(80)} - {_below(20)}) / max(total) AS v FROM {_seg} WHERE total > 0 GROUP BY 1, 2")
q("histogram_count", f"histogram_count({B})", B, ET, f"SELECT event_type, ts, max(total) AS v FROM {_seg} GROUP BY 1, 2")
q("histogram_sum", f"histogram_sum({B})", B, ET, f"SELECT event_type, ts, {_sum} AS v FROM {_seg} GROUP BY 1, 2")
q("histogram_avg", f"histogram_avg({B})", B, ET, f"SELECT event_type, ts, {_sum} / max(total) AS v FROM {_seg} WHERE total > 0 GROUP BY 1, 2")
q("histogram_stdvar", f"histogram_stdvar({B})", B, ET, f"SELECT event_type, ts, {_var} AS v FROM {_mean} GROUP BY 1, 2", digits=4)
q("histogram_stddev", f"histogram_stddev({B})", B, ET, f"SELECT event_type, ts, sqrt({_var}) AS v FROM {_mean} GROUP BY 1, 2")

# subqueries, rules
_inner = f"(SELECT event_type, h AS t, max(v) AS v FROM (SELECT event_type, h, v FROM (SELECT unnest(range({START} - {DAY}, {END} + 1, 3600000)) AS h) JOIN {V} ON t BETWEEN h - 21600000 AND h) GROUP BY 1, 2)"
q("subquery_max", f"avg_over_time(max_over_time({V}[6h])[1d:1h])", V, ET, f"SELECT event_type, ts, avg(v) AS v FROM {_inner} JOIN grid ON t BETWEEN ts - {DAY} AND ts GROUP BY 1, 2")
q("subquery_offset", f"max_over_time(max_over_time({V}[6h])[12h:1h] offset 6h)", V, ET, f"SELECT event_type, ts, max(v) AS v FROM {_inner} JOIN grid ON t BETWEEN ts - 64800000 AND ts - 21600000 GROUP BY 1, 2")
q("subquery_scalar", "sum_over_time(vector(2)[1d:6h])", V, (), "SELECT ts, 10 AS v FROM grid")
q("subquery_nested", f"max_over_time(avg_over_time(sum_over_time({V}[6h])[6h:3h])[12h:6h])", V, ET, None)
q("recording_rule", "type:rate6h * 60", C, ET, f"SELECT event_type, ts, v * 60 AS v FROM ({rate(C, 21_600_000)})", rules=(("type:rate6h", f"rate({C}[6h])"),), digits=6)
q("recording_rule_matched", 'type:rate6h{event_type="click"}', C, ET, f"SELECT event_type, ts, v FROM ({rate(C, 21_600_000)}) WHERE event_type = 'click'", rules=(("type:rate6h", f"rate({C}[6h])"),), digits=9)
q("repeated_average", f"(rate({C}[1d]) + rate({C}[1d])) / 2", C, ET, rate(C), digits=9)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(catalog(spark, sf_dir)).labels()


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(catalog(spark, sf_dir)).label_values("event_type", ['{event_type=~"..+"}'])


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(Engine(catalog(spark, sf_dir)).series([V, N]), "__name__", "event_type", "orderstatus", "orderpriority")


def _series_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_labels(Engine(catalog(spark, sf_dir)).series(['events_value{event_type="click"}'], BOUNDED[0] / 1000, BOUNDED[1] / 1000), "event_type", "user_id")


METADATA: dict[str, tuple[Callable, str]] = {
    "labels": (_labels, "SELECT unnest(['__name__', 'event_type', 'user_id', 'le', 'returnflag', 'linestatus', 'orderstatus', 'orderpriority', 'job', 'instance', 'region']) AS label"),
    "label_values": (_values, "SELECT DISTINCT event_type AS value FROM events"),
    "series": (_series, f"SELECT DISTINCT '{V}' AS __name__, event_type, '' AS orderstatus, '' AS orderpriority FROM events UNION ALL SELECT DISTINCT '{N}', '', o_orderstatus, o_orderpriority FROM orders"),
    "series_bounded": (_series_bounded, f"SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click' AND epoch_us(ts) // 1000 BETWEEN {BOUNDED[0]} AND {BOUNDED[1]}"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: x.run for n, x in REGISTERED.items()} | {n: f for n, (f, _) in METADATA.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, x in REGISTERED.items() if (s := x.oracle())} | {n: s for n, (_, s) in METADATA.items()}
