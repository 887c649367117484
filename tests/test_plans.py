"""Plan-shape checks: the properties the scale design relies on."""
import pytest

from marketlake.operators import versioned as V
from marketlake.plans import reports as R
from marketlake.sources.testdata import Star

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF001)


def test_date_filter_pushed_and_columns_pruned(star):
    p = _plan(R.top_categories(star, R.DEFAULT_AS_OF))
    assert "GreaterThanOrEqual(o_orderdate" in p
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in p  # 3 of 11 lineitem columns


def test_latest_version_is_an_aggregate_not_a_window(spark, star):
    ev = star.raw("events")
    p = _plan(V.latest_version(ev, ["user_id"], ["ts", "event_id"]))
    assert "Window" not in p and "max_by" in p
    assert "partial_max_by" in p or "Partial" in p or p.count("max_by") >= 2  # map-side step present


def test_top_k_per_query_is_limited_before_the_shuffle(spark):
    from marketlake.operators import search as S
    docs = spark.createDataFrame([(i, f"n{i}", "bolt nut", "c") for i in range(50)],
                                 "id long, name string, description string, category string")
    q = spark.createDataFrame([(1, "bolt")], "query_id long, query string")
    df = S.search(docs, q, "id", k=5)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_product_reports_aggregate_before_the_product_join(star):
    p = R.top_categories(star, R.DEFAULT_AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    # the first aggregate (per product) sits below the join with part
    join_at = p.find("Join Inner")
    assert join_at != -1 and "Aggregate [product_id" in p[join_at:]
