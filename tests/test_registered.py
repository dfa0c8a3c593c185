"""Registered queries against their SQL, on the smallest tables; the entry point."""

import importlib
import sys

import pytest

import __spark_entry__
from tests import oracle
from tidemark import queries as metrics

SF = "/root/testdata/sf0.001"
SOME = ("selector_grid", "matcher_regex", "at_end", "rate", "irate", "changes", "quantile_over_time", "agg_quantile", "topk_by", "count_values", "match_fill", "match_group_left_labels", "set_or", "info", "label_replace", "histogram_quantile", "histogram_fraction", "subquery_max", "recording_rule_matched", "series_store", "labels", "series")


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), metrics.queries()[name], metrics.oracle_sql()[name], SF) in ("", "no rows")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import tidemark

    monkeypatch.delattr(tidemark, "llm", raising=False)
    bare = importlib.reload(__spark_entry__)
    try:
        assert not any(n.startswith("op") for n in bare.queries()) and set(metrics.queries()) == set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


@pytest.mark.parametrize(("name", "column", "low"), [("selector_grid", "ts", True), ("topk_by", "o_orderdate", True), ("histogram_quantile", "ts", True), ("rate", "ts", False)])
def test_times_prune_the_scan(spark, capsys, name, column, low):
    metrics.queries()[name](spark, SF).explain("formatted")
    pushed = [x for x in capsys.readouterr().out.splitlines() if x.startswith("PushedFilters")]
    assert pushed and all(f"LessThan({column}," in x for x in pushed)
    assert all((f"GreaterThanOrEqual({column}," in x) == low for x in pushed)
