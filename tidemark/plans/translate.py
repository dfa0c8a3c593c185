"""From syntax tree to DataFrames: one lazy plan a node, for one evaluation grid."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadData, Unsupported
from ..functions import exprs as X
from ..functions import labels as L
from ..operators import aggregate as agg
from ..operators import histogram as hist
from ..operators import matching, window
from ..operators.grid import Grid, seconds
from ..sources.metrics import Catalog
from .ast import Aggregate, Binary, Call, Matcher, Matching, Negative, Node, Number, Selector, Shift, String, Subquery
from .parser import COMPARISONS, SETS


#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 50_000


@dataclass
class Scalar:
    """A value for each time: an expression of the time column, or a table (ts, value) of so many points."""

    of: Callable[[Column], Column] | None = None
    table: DataFrame | None = None
    constant: float | None = None
    points: int = 0


@dataclass
class Vector:
    """Rows (lkey, ts, value). ``named``: all series have one metric name, so dropping it keeps them
    apart. ``sample_time``: a column ``st`` has the time of the sample itself."""

    rows: DataFrame
    named: bool = False
    sample_time: bool = False


@dataclass
class Samples:
    """Samples (lkey, t, value) for windows of ``span`` ms that end ``offset`` ms before the grid."""

    rows: DataFrame
    span: int
    grid: Grid
    offset: int = 0
    pinned: bool = False
    named: bool = False


def const(x: float) -> Scalar:
    return Scalar(lambda ts: X.lit(x), None, float(x))


SCALAR_CALLS = frozenset(("time", "pi", "scalar"))
CLAMPS = frozenset(("clamp", "clamp_min", "clamp_max"))
SORTS = frozenset(("sort", "sort_desc", "sort_by_label", "sort_by_label_desc"))
HISTOGRAMS = {"histogram_count": "count", "histogram_sum": "sum", "histogram_avg": "avg", "histogram_stddev": "stddev", "histogram_stdvar": "stdvar"}
FUNCTIONS = window.FUNCTIONS | SCALAR_CALLS | CLAMPS | SORTS | set(X.MATH) | set(X.DATES) | set(HISTOGRAMS) | {"round", "timestamp", "vector", "absent", "absent_over_time", "label_replace", "label_join", "info", "histogram_quantile", "histogram_quantiles", "histogram_fraction", "holt_winters"}


def go_template(repl: str, pattern: str) -> list[tuple[str, int | str]]:
    """Parts of a replacement: ('text', s) and ('group', number); unknown groups are empty."""
    import re

    names = {m[1]: i for i, m in enumerate(_groups(pattern), 1) if m[1]}
    count = sum(1 for _ in _groups(pattern))
    out: list[tuple[str, int | str]] = []
    at = 0
    for m in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)", repl):
        out.append(("text", repl[at : m.start()]))
        at = m.end()
        if m[0] == "$$":
            out.append(("text", "$"))
            continue
        ref = m[1] or m[2]
        n = int(ref) if ref.isdigit() else names.get(ref, -1)
        if 0 <= n <= count:
            out.append(("group", n))
    return [p for p in [*out, ("text", repl[at:])] if p[1] != ""]


def _groups(pattern: str):
    """Capturing groups in order; item 1 of each is its name or ''."""
    import re

    for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?P?<(\w+)>|(\?))?", pattern):
        if m[0].startswith("(") and not m[2]:
            yield m


def java_pattern(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


class Translator:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.memo: dict[tuple[Node, Grid], object] = {}

    # -- values ---------------------------------------------------------------
    def eval(self, node: Node, grid: Grid):
        """Equal nodes on one grid share a plan, so that Spark can reuse its exchanges."""
        key = (node, grid)
        if key not in self.memo:
            self.memo[key] = self._eval(node, grid)
        return self.memo[key]

    def _eval(self, node: Node, grid: Grid):
        if isinstance(node, Number):
            return const(node.value)
        if isinstance(node, String):
            return node.value
        if isinstance(node, Selector):
            return self.range_selector(node, grid) if node.range is not None else self.instant_selector(node, grid)
        if isinstance(node, Subquery):
            return self.subquery(node, grid)
        if isinstance(node, Negative):
            v = self.eval(node.expr, grid)
            if isinstance(v, Scalar):
                return const(-v.constant) if v.constant is not None else self.scalar_map(v, lambda x: -x)
            return self.mapped(self.need_vector(v, "-"), lambda x, _: -x)
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        raise Unsupported(type(node).__name__)

    def need_vector(self, v, what: str) -> Vector:
        if not isinstance(v, Vector):
            raise BadData(f"{what} needs an instant vector")
        return v

    def vector(self, node: Node, grid: Grid, what: str) -> Vector:
        return self.need_vector(self.eval(node, grid), what)

    def number(self, node: Node, grid: Grid, what: str) -> float:
        v = self.eval(node, grid)
        if not isinstance(v, Scalar) or v.constant is None:
            raise BadData(f"{what} needs a constant number")
        return v.constant

    def text(self, node: Node, what: str) -> str:
        if not isinstance(node, String):
            raise BadData(f"{what} needs a string")
        return node.value

    def scalar_map(self, s: Scalar, fn: Callable[[Column], Column]) -> Scalar:
        if s.table is not None:
            return Scalar(table=s.table.withColumn("value", fn(F.col("value"))), points=s.points)
        return Scalar(lambda ts: fn(s.of(ts)))

    def scalar_rows(self, s: Scalar, grid: Grid) -> DataFrame:
        if s.table is not None:
            return s.table
        return grid.frame(self.spark).select("ts", s.of(F.col("ts")).alias("value"))

    def with_scalar(self, rows: DataFrame, s: Scalar, name: str) -> DataFrame:
        """Adds a scalar's value; a table of it has a row for each time of the grid and is broadcast if
        these are few, which the grid of a subquery need not be."""
        if s.table is None:
            return rows.withColumn(name, s.of(F.col("ts")))
        table = s.table.select("ts", F.col("value").alias(name))
        return rows.join(F.broadcast(table) if s.points <= BROADCAST_ROWS else table, "ts", "left").withColumn(name, F.coalesce(name, X.lit(X.NAN)))

    # -- selectors ------------------------------------------------------------
    def pinned(self, shift: Shift, grid: Grid) -> int | None:
        return None if shift.at is None else {"start": grid.start, "end": grid.end}.get(shift.at, shift.at)

    def instant_selector(self, node: Selector, grid: Grid) -> Vector:
        at, own = self.pinned(node.shift, grid), grid
        if at is not None:
            own = grid.at(at)
        off, back = node.shift.offset, grid.lookback
        rows = self.catalog.scan(node.matchers, own.start - off - back, own.end - off)
        found = own.spread(rows, back, off).groupBy("lkey", "ts").agg(F.max_by("value", "t").alias("value"), F.max("t").alias("st"))
        found = found.where(~F.isnan("value"))
        if at is not None and not grid.instant:
            found = grid.repeated(found.drop("ts"))
        elif at is not None:
            found = found.withColumn("ts", F.lit(grid.start).cast("long"))
        return Vector(found, self.catalog.one_metric(node.matchers), True)

    def range_selector(self, node: Selector, grid: Grid) -> Samples:
        at = self.pinned(node.shift, grid)
        own = grid if at is None else grid.at(at)
        off = node.shift.offset
        rows = self.catalog.scan(node.matchers, own.start - off - node.range, own.end - off)
        return Samples(rows, node.range, own, off, at is not None, self.catalog.one_metric(node.matchers))

    def subquery(self, node: Subquery, grid: Grid) -> Samples:
        at = self.pinned(node.shift, grid)
        own = grid if at is None else grid.at(at)
        step = node.step or (60_000 if grid.instant else grid.step)
        off = node.shift.offset
        low, high = own.start - off - node.range, own.end - off
        first = -(-low // step) * step
        last = high // step * step
        inner = Grid(first, max(first, last), step, False, grid.lookback)
        v = self.eval(node.expr, inner)
        rows = self.scalar_rows(v, inner).withColumn("lkey", F.lit("")) if isinstance(v, Scalar) else self.need_vector(v, "a subquery").rows
        return Samples(rows.select("lkey", F.col("ts").alias("t"), "value").where(F.col("t") <= high), node.range, own, off, at is not None, isinstance(v, Vector) and v.named)

    def windowed(self, name: str, s: Samples, grid: Grid, args: list[float]) -> Vector:
        rows = window.with_previous(s.rows) if name in window.NEIGHBOURS else s.rows
        out = window.apply(name, s.grid.spread(rows, s.span, s.offset), s.span, s.offset, args)
        if s.pinned:
            out = grid.repeated(out.drop("ts")) if not grid.instant else out.withColumn("ts", F.lit(grid.start).cast("long"))
        if name in window.KEEP_NAME:
            return Vector(out, s.named)
        return self.without_name(Vector(out, s.named))

    # -- labels ---------------------------------------------------------------
    def without_name(self, v: Vector) -> Vector:
        rows = v.rows.withColumn("lkey", L.drop(F.col("lkey"), (L.NAME,))).select("lkey", "ts", "value")
        return Vector(rows if v.named else self.distinct(rows), True)

    def distinct(self, rows: DataFrame) -> DataFrame:
        return matching.unique(rows, "vector cannot contain metrics with the same labelset")

    def mapped(self, v: Vector, fn: Callable[[Column, Column], Column]) -> Vector:
        return self.without_name(Vector(v.rows.withColumn("value", fn(F.col("value"), F.col("ts"))), v.named))

    # -- operators ------------------------------------------------------------
    def aggregate(self, node: Aggregate, grid: Grid) -> Vector:
        v = self.vector(node.expr, grid, node.op)
        param = None
        if node.op == "count_values":
            param = self.text(node.param, node.op)
        elif node.param is not None:
            param = self.number(node.param, grid, node.op)
        out = agg.aggregate(node.op, v.rows.select("lkey", "ts", "value"), node.labels, node.without, node.grouped, param)
        keeps = node.op in ("topk", "bottomk", "limitk", "limit_ratio")
        return Vector(out, v.named if keeps else True)

    def binary(self, node: Binary, grid: Grid):
        op, comparison = node.op, node.op in COMPARISONS
        l, r = self.eval(node.left, grid), self.eval(node.right, grid)  # noqa: E741
        if isinstance(l, Scalar) and isinstance(r, Scalar):
            return self.scalars(node, l, r, grid)
        if op in SETS:
            m = node.matching
            out = matching.set_operation(op, self.need_vector(l, op).rows, self.need_vector(r, op).rows, m)
            return Vector(out, l.named and (op != "or" or r.named and self._name(node.left) == self._name(node.right)))
        if isinstance(l, Scalar) or isinstance(r, Scalar):
            v, s = (self.need_vector(r, op), l) if isinstance(l, Scalar) else (self.need_vector(l, op), r)
            rows = self.with_scalar(v.rows, s, "_s")
            a, b = (F.col("_s"), F.col("value")) if isinstance(l, Scalar) else (F.col("value"), F.col("_s"))
            if comparison and not node.bool_:
                return Vector(rows.where(X.compare(op, a, b)).select("lkey", "ts", "value"), v.named)
            value = F.when(X.compare(op, a, b), 1.0).otherwise(0.0) if comparison else X.arithmetic(op, a, b)
            return self.without_name(Vector(rows.withColumn("value", value), v.named))
        if node.left == node.right and node.matching == Matching() and not (comparison and not node.bool_) and l.named:
            # both sides are one vector of distinct series: no join
            same = F.when(X.compare(op, F.col("value"), F.col("value")), 1.0).otherwise(0.0) if comparison else X.arithmetic(op, F.col("value"), F.col("value"))
            return self.mapped(l, lambda x, _: same)
        out = matching.binary(op, self.need_vector(l, op).rows, self.need_vector(r, op).rows, node.matching, node.bool_, comparison)
        return Vector(out, True)

    def _name(self, node: Node) -> str | None:
        return node.name if isinstance(node, Selector) else None

    def scalars(self, node: Binary, l: Scalar, r: Scalar, grid: Grid) -> Scalar:  # noqa: E741
        op = node.op
        if op in SETS:
            raise BadData(f"{op} needs instant vectors")
        if op in COMPARISONS and not node.bool_:
            raise BadData("comparisons between scalars must use bool")
        both = lambda a, b: F.when(X.compare(op, a, b), 1.0).otherwise(0.0) if op in COMPARISONS else X.arithmetic(op, a, b)
        if l.constant is not None and r.constant is not None:
            return const(folded(op, l.constant, r.constant))
        if l.table is None and r.table is None:
            return Scalar(lambda ts: both(l.of(ts), r.of(ts)))
        rows = self.with_scalar(self.with_scalar(grid.frame(self.spark), l, "_l"), r, "_r")
        return Scalar(table=rows.select("ts", both(F.col("_l"), F.col("_r")).alias("value")), points=grid.last + 1)

    # -- functions ------------------------------------------------------------
    def call(self, node: Call, grid: Grid):
        name, args = node.name, node.args
        if name not in FUNCTIONS:
            raise BadData(f"unknown function {name!r}")
        counts = {"time": (0, 0), "pi": (0, 0), "clamp": (3, 3), "clamp_min": (2, 2), "clamp_max": (2, 2), "round": (1, 2), "label_replace": (5, 5), "histogram_quantile": (2, 2), "histogram_fraction": (3, 3), "quantile_over_time": (2, 2), "predict_linear": (2, 2), "double_exponential_smoothing": (3, 3), "info": (1, 2)}
        low, high = counts.get(name, (0, 1) if name in X.DATES else (3, 99) if name in ("label_join", "histogram_quantiles") else (2, 99) if name.startswith("sort_by") else (1, 1))
        if not low <= len(args) <= high:
            raise BadData(f"wrong number of arguments for {name}")
        if name == "time":
            return Scalar(lambda ts: seconds(ts))
        if name == "pi":
            return const(math.pi)
        if name in window.FUNCTIONS or name == "absent_over_time":
            return self.range_call(name, args, grid)
        if name == "vector":
            v = self.eval(args[0], grid)
            if not isinstance(v, Scalar):
                raise BadData("vector needs a scalar")
            return Vector(self.scalar_rows(v, grid).select(F.lit("").alias("lkey"), "ts", "value"), True)
        if name == "scalar":
            v = self.vector(args[0], grid, name)
            one = v.rows.groupBy("ts").agg(F.count("*").alias("n"), F.max("value").alias("v"))
            rows = grid.frame(self.spark).join(one, "ts", "left")
            return Scalar(table=rows.select("ts", F.when(F.col("n") == 1, F.col("v")).otherwise(X.lit(X.NAN)).alias("value")), points=grid.last + 1)
        if name == "absent":
            return self.absent(self.vector(args[0], grid, name).rows, args[0], grid)
        if name == "timestamp":
            v = self.vector(args[0], grid, name)
            return self.without_name(Vector(v.rows.withColumn("value", seconds(F.col("st") if v.sample_time else F.col("ts"))), v.named))
        if name in X.MATH:
            return self.mapped(self.vector(args[0], grid, name), lambda x, _: X.MATH[name](x))
        if name in X.DATES:
            if not args:
                rows = grid.frame(self.spark).select(F.lit("").alias("lkey"), "ts", X.DATES[name](seconds(F.col("ts"))).alias("value"))
                return Vector(rows, True)
            return self.mapped(self.vector(args[0], grid, name), lambda x, _: X.DATES[name](x))
        if name in CLAMPS:
            return self.clamp(name, args, grid)
        if name == "round":
            unit = self.number(args[1], grid, name) if len(args) > 1 else 1.0
            if not unit or not math.isfinite(unit):
                raise BadData("round needs a finite unit other than 0")
            return self.mapped(self.vector(args[0], grid, name), lambda x, _: X.round_to(x, X.lit(unit)))
        if name in SORTS:
            return self.sorted(name, args, grid)
        if name == "label_replace":
            return self.label_replace(args, grid)
        if name == "label_join":
            v = self.vector(args[0], grid, name)
            dst, sep, *src = (self.text(a, name) for a in args[1:])
            value = F.concat_ws(sep, *(L.get(F.col("lkey"), s) for s in src))
            return self.relabelled(v, L.put(F.col("lkey"), dst, value))
        if name == "info":
            return self.info(args, grid)
        if name == "histogram_quantile":
            return Vector(hist.quantile(self.vector(args[1], grid, name).rows, self.number(args[0], grid, name)), True)
        if name == "histogram_quantiles":
            return Vector(hist.quantiles(self.vector(args[0], grid, name).rows, self.text(args[1], name), [self.number(a, grid, name) for a in args[2:]]), True)
        if name == "histogram_fraction":
            return Vector(hist.fraction(self.vector(args[2], grid, name).rows, self.number(args[0], grid, name), self.number(args[1], grid, name)), True)
        return Vector(hist.moments(self.vector(args[0], grid, name).rows, HISTOGRAMS[name]), True)

    def range_call(self, name: str, args: tuple[Node, ...], grid: Grid) -> Vector:
        at = 1 if name == "quantile_over_time" else 0
        s = self.eval(args[at], grid)
        if not isinstance(s, Samples):
            raise BadData(f"{name} needs a range vector")
        if name == "absent_over_time":
            return self.absent(self.windowed("present_over_time", s, grid, []).rows, args[0], grid)
        numbers = [self.number(a, grid, name) for i, a in enumerate(args) if i != at]
        if name == "double_exponential_smoothing" and not all(0 < x < 1 for x in numbers):
            raise BadData("smoothing factors lie between 0 and 1")
        return self.windowed(name, s, grid, numbers)

    def absent(self, rows: DataFrame, node: Node, grid: Grid) -> Vector:
        """1 at each time without a series, with the labels that equality matchers pin."""
        named: dict[str, str] = {}
        if isinstance(node, Selector):
            seen = [m.label for m in node.matchers]
            named = {m.label: m.value for m in node.matchers if m.op == "=" and m.value and m.label != L.NAME and seen.count(m.label) == 1}
        key = L.from_columns({n: F.lit(v) for n, v in named.items()})
        rest = grid.frame(self.spark).join(rows.select("ts").distinct(), "ts", "left_anti")
        return Vector(rest.select(key.alias("lkey"), "ts", X.lit(1).alias("value")), True)

    def clamp(self, name: str, args: tuple[Node, ...], grid: Grid) -> Vector:
        v = self.vector(args[0], grid, name)
        rows = v.rows
        for i, a in enumerate(args[1:]):
            s = self.eval(a, grid)
            if not isinstance(s, Scalar):
                raise BadData(f"{name} needs scalar bounds")
            rows = self.with_scalar(rows, s, f"_b{i}")
        value, lo, hi = F.col("value"), F.col("_b0"), F.col("_b1")
        if name == "clamp":
            rows = rows.where(~X.compare("<", hi, lo)).withColumn("value", X.clamp_min(X.clamp_max(value, hi), lo))
        else:
            rows = rows.withColumn("value", X.clamp_min(value, lo) if name == "clamp_min" else X.clamp_max(value, lo))
        return self.without_name(Vector(rows, v.named))

    def sorted(self, name: str, args: tuple[Node, ...], grid: Grid) -> Vector:
        v = self.vector(args[0], grid, name)
        rows = v.rows.select("lkey", "ts", "value")
        if name in ("sort", "sort_desc"):
            order = [F.isnan("value"), F.col("value").desc() if name == "sort_desc" else F.col("value").asc(), F.col("lkey")]
        else:
            names = [self.text(a, name) for a in args[1:]]
            # runs of digits compare as numbers: each has its length before it
            number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
            sized = lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 9, "0"), number(p))).otherwise(p)
            pad = lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1), sized), "")
            order = [pad(L.get(F.col("lkey"), n)) for n in names] + [F.col("lkey")]
            order = [c.desc() for c in order] if name.endswith("desc") else order
        return Vector(rows.orderBy("ts", *order), v.named)

    def relabelled(self, v: Vector, key: Column) -> Vector:
        return Vector(self.distinct(v.rows.withColumn("lkey", key).select("lkey", "ts", "value")), False)

    def label_replace(self, args: tuple[Node, ...], grid: Grid) -> Vector:
        v = self.vector(args[0], grid, "label_replace")
        dst, repl, src, pattern = (self.text(a, "label_replace") for a in args[1:])
        from .parser import check_pattern

        check_pattern(Matcher(dst, "=~", pattern))
        whole = rf"(?s)\A(?:{java_pattern(pattern)})\z"
        value = L.get(F.col("lkey"), src)
        pieces = [F.lit(x) if kind == "text" else F.regexp_extract(value, whole, x) for kind, x in go_template(repl, pattern)]
        new = F.concat(*pieces) if pieces else F.lit("")
        return self.relabelled(v, F.when(value.rlike(whole), L.put(F.col("lkey"), dst, new)).otherwise(F.col("lkey")))

    def info(self, args: tuple[Node, ...], grid: Grid) -> Vector:
        v = self.vector(args[0], grid, "info")
        own: tuple[Matcher, ...] = args[1].matchers if len(args) > 1 and isinstance(args[1], Selector) else ()
        names = tuple(m for m in own if m.label == L.NAME) or (Matcher(L.NAME, "=", "target_info"),)
        data = [m for m in own if m.label != L.NAME]
        from ..sources.metrics import matches_text

        infos = self.instant_selector(Selector((*names, *data)), grid)
        optional = all(matches_text("", m) for m in data)
        return Vector(matching.info(v.rows.select("lkey", "ts", "value"), infos.rows, sorted({m.label for m in data}) or None, optional), v.named)


def folded(op: str, a: float, b: float) -> float:
    """Constant operands, with the results of the hardware."""
    if op in COMPARISONS:
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op])
    try:
        if op == "/":
            return a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        if op == "%":
            return math.fmod(a, b) if b else math.nan
        if op == "^":
            return math.pow(a, b)
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    except (ValueError, OverflowError):
        return math.nan if isinstance(a, float) and a != a else math.inf if op == "^" and abs(a) > 1 else math.nan
