"""The registered queries with and without the llm package, and scratch tables that go with their scope."""

import builtins
import os
import sys

import __spark_entry__ as entry
from eavesgraph.session import scratch_dir, scratch_scope, written


def test_queries_stay_when_the_llm_package_cannot_be_imported(monkeypatch):
    keep = builtins.__import__

    def broken(name, *a, **k):
        if name == "eavesgraph.llm.queries":
            raise ImportError(name)
        return keep(name, *a, **k)

    import importlib

    real = importlib.import_module
    monkeypatch.setattr(importlib, "import_module", lambda name, *a: broken(name) if name == "eavesgraph.llm.queries" else real(name, *a))
    monkeypatch.delitem(sys.modules, "eavesgraph.llm.queries", raising=False)
    left = entry.queries()
    assert "p1_found" in left and "p2_found" not in left and not set(entry.oracle_sql()) - set(left)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_tables_go_with_their_scope(spark):
    folder = scratch_dir(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    with scratch_scope(spark):
        df, path = written(spark.range(5), "scope")
        assert df.count() == 5 and set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before
