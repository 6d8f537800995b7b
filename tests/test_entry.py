"""The entry module with and without the optional subpackage."""

import importlib.util

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "sources", "rank_score"] and df.count() == 20


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "win5_trending" in entry.queries()


def test_without_the_optional_subpackage(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("newsgrain.llm", "corpus_pipeline")) else find(name, *a))
    names = set(entry.queries())
    assert "win5_trending" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names


def test_code_is_shipped_once(spark):
    entry._ship(spark)
    entry._ship(spark)
    assert spark.sparkContext._newsgrain_shipped
