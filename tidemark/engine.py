"""The query surface: instant and range queries, metadata, explain."""

from __future__ import annotations

import io
from collections.abc import Sequence
from contextlib import redirect_stdout

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import BadData, ExecutionError
from .functions import labels as L
from .operators.grid import LOOKBACK, Grid
from .plans.ast import Node, Selector, tree
from .plans.parser import parse
from .plans.rules import Rules
from .plans.translate import BROADCAST_ROWS, Samples, Scalar, Translator, Vector
from .sources.metrics import Catalog
from .times import duration_ms, instant_ms

#: Points a series and series of a range query, at most, where a guard is asked for.
MAX_POINTS, MAX_SERIES = 50_000, 5_000


class Engine:
    def __init__(self, catalog: Catalog, rules: Rules | None = None, lookback: str | float = LOOKBACK / 1000):
        self.catalog, self.rules, self.lookback = catalog, rules or Rules(), duration_ms(lookback)

    def _tree(self, query: str | Node) -> Node:
        return self.rules.expand(parse(query) if isinstance(query, str) else query)

    def query(self, query: str | Node, time, limit: int | None = None) -> DataFrame:
        """Instant query: rows (lkey, ts_ms, value); a bare selector has its samples' own times, a range
        vector all its samples."""
        t = instant_ms(time)
        grid = Grid(t, t, 1, True, self.lookback)
        node = self._tree(query)
        tr = Translator(self.catalog)
        v = tr.eval(node, grid)
        if isinstance(v, Samples):
            rows = v.grid.spread(v.rows, v.span, v.offset).select("lkey", F.col("t").alias("ts_ms"), "value")
        elif isinstance(v, Vector) and isinstance(node, Selector):
            rows = v.rows.select("lkey", F.col("st").alias("ts_ms"), "value")
        else:
            rows = self._rows(tr, v, grid)
        return self._limited(rows, limit)

    def query_range(self, query: str | Node, start, end, step, limit: int | None = None) -> DataFrame:
        """Range query: rows (lkey, ts_ms, value) on the grid from start to end, both included."""
        s, e, st = instant_ms(start), instant_ms(end), duration_ms(step)
        if e < s:
            raise BadData("end is before start")
        if st <= 0:
            raise BadData("step must be positive")
        if (e - s) // st >= MAX_POINTS:
            raise BadData(f"more than {MAX_POINTS} points a series")
        grid = Grid(s, e, st, False, self.lookback)
        tr = Translator(self.catalog)
        v = tr.eval(self._tree(query), grid)
        if isinstance(v, Samples):
            raise BadData("a range query needs a scalar or an instant vector")
        return self._limited(self._rows(tr, v, grid), limit)

    def _rows(self, tr: Translator, v, grid: Grid) -> DataFrame:
        if isinstance(v, Scalar):
            return tr.scalar_rows(v, grid).select(F.lit("").alias("lkey"), F.col("ts").alias("ts_ms"), "value")
        if not isinstance(v, Vector):
            raise BadData("a string is no result")
        return v.rows.select("lkey", F.col("ts").alias("ts_ms"), "value")

    def _limited(self, rows: DataFrame, limit: int | None) -> DataFrame:
        """Only the first series by label key, where a limit is asked for."""
        if not limit:
            return rows
        first = rows.select("lkey").distinct().orderBy("lkey").limit(limit)
        return rows.join(F.broadcast(first) if limit <= BROADCAST_ROWS else first, "lkey", "left_semi")

    def guard(self, rows: DataFrame, max_series: int = MAX_SERIES) -> DataFrame:
        """The rows, if they have no more series than allowed."""
        if rows.select("lkey").distinct().limit(max_series + 1).count() > max_series:
            raise ExecutionError(f"more than {max_series} series")
        return rows

    # -- metadata -------------------------------------------------------------
    def series(self, match: Sequence[str], start=None, end=None) -> DataFrame:
        """(lkey): distinct label sets that any selector matches."""
        low = None if start is None else instant_ms(start)
        high = None if start is None else instant_ms(end)
        out = None
        for m in match or ('{__name__=~".+"}',):
            node = parse(m)
            if not isinstance(node, Selector) or node.range is not None:
                raise BadData("match needs plain selectors")
            d = self.catalog.series(node.matchers, low, high)
            out = d if out is None else out.unionByName(d)
        return out.distinct()

    def labels(self, match: Sequence[str] = (), start=None, end=None) -> DataFrame:
        """(label): distinct label names."""
        keys = self.series(match, start, end)
        return keys.select(F.explode(L.parts(F.col("lkey"))).alias("p")).where("p <> ''").select(F.substring_index("p", L.KV, 1).alias("label")).distinct()

    def label_values(self, label: str, match: Sequence[str] = (), start=None, end=None) -> DataFrame:
        """(value): distinct values of a label."""
        return self.series(match, start, end).select(L.get(F.col("lkey"), label).alias("value")).where("value <> ''").distinct()

    def selector_stats(self, match: str, cap: int | None = None) -> int:
        """Number of matching series, counted no further than ``cap`` + 1."""
        d = self.series([match])
        return d.count() if cap is None else d.limit(cap + 1).count()

    # -- tools ----------------------------------------------------------------
    def explain(self, query: str, start, end=None, step="1m") -> dict:
        """Expanded query, its tree and Spark's formatted plan."""
        node = self._tree(query)
        rows = self.query(node, start) if end is None else self.query_range(node, start, end, step)
        out = io.StringIO()
        with redirect_stdout(out):
            rows.explain("formatted")
        return {"query": str(node), "tree": tree(node), "plan": out.getvalue()}

    @staticmethod
    def format(query: str) -> str:
        return str(parse(query))

    @staticmethod
    def parse(query: str) -> dict:
        return tree(parse(query))


def with_labels(rows: DataFrame, *names: str) -> DataFrame:
    """Plain columns for labels in place of the key."""
    return rows.select(*(L.get(F.col("lkey"), n).alias(n) for n in names), *(c for c in rows.columns if c != "lkey"))


def render(rows: DataFrame, matrix: bool = True) -> dict:
    """The JSON envelope of a small result, as the public HTTP API has it."""
    from .plans.ast import number_text

    found: dict[str, list] = {}
    for r in rows.orderBy("lkey", "ts_ms").toLocalIterator():
        found.setdefault(r["lkey"], []).append([r["ts_ms"] / 1000, number_text(r["value"])])
    as_map = lambda k: dict(p.split(L.KV, 1) for p in k.split(L.SEP) if p)
    result = [{"metric": as_map(k), "values": v} if matrix else {"metric": as_map(k), "value": v[-1]} for k, v in found.items()]
    return {"status": "success", "data": {"resultType": "matrix" if matrix else "vector", "result": result}}
