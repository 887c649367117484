"""Driver contract and the SQL oracle on the smallest scale factor."""
import os
import sys

import pytest

from conftest import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["main_category", "order_count", "items_sold", "category_revenue", "revenue_percentage"]
    assert df.count() >= 0


def test_every_query_has_an_oracle_or_is_listed():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(__import__("__spark_entry__").queries()))
def test_query_matches_oracle(spark, name):
    import oracle_check as OC
    import __spark_entry__ as E

    sql = E.oracle_sql().get(name)
    df = E.queries()[name](spark, SF001)
    if sql is None:
        assert df.count() >= 0
        return
    assert OC.compare(name, df, OC.duck_conn(SF001), sql, verbose=False)


def test_cli_lists_every_query(capsys):
    """Of the library; the corpus queries are registered by the entry alone."""
    from marketlake.__main__ import main
    from marketlake.plans import registry

    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert all(name in out for name in registry.queries())


def test_entry_works_without_the_corpus_part(monkeypatch):
    import importlib
    import __spark_entry__ as E

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(E)
        assert "top_sellers" in alone.queries() and not any(n.startswith("op1_") for n in alone.queries())
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(E)
