"""Registered range queries span their whole tables."""

import duckdb
import pytest

from tidemark import queries as metrics

SF = "/root/testdata/sf0.1"
TABLES = {"events": ("events", "ts"), "orders": ("orders", "o_orderdate"), "lineitem": ("lineitem", "l_shipdate")}


@pytest.mark.parametrize("table", TABLES)
def test_range_queries_span_their_tables(table):
    name, column = TABLES[table]
    low, high = duckdb.connect().execute(f"SELECT epoch_ms(min({column})), epoch_ms(max({column})) FROM read_parquet('{SF}/{name}.parquet')").fetchone()
    own = {n: q for n, q in metrics.REGISTERED.items() if not q.instant and q.metrics and any(m.startswith(table) for m in q.metrics)}
    assert own
    for n, q in own.items():
        assert q.start - 21_600_000 <= low and q.start + (q.end - q.start) // q.step * q.step >= high, n
