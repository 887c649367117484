"""Report invariants and golden values (FIXTURES section 7) at sf0.01."""
import math

import pytest

from marketlake.plans import reports as R
from marketlake.sources.testdata import Star

from conftest import SF01


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, SF01)


def test_golden_category_distribution(star):
    rows = {r.main_category: r for r in R.category_distribution(star, R.DEFAULT_AS_OF).collect()}
    assert len(rows) == 6
    assert rows["MEDIUM"].order_count == 105 and rows["MEDIUM"].category_revenue == pytest.approx(3851807.2)
    assert rows["MEDIUM"].revenue_percentage == pytest.approx(19.059813, abs=1e-6)
    assert math.isclose(sum(r.revenue_percentage for r in rows.values()), 100.0, abs_tol=1e-9)


def test_golden_top_sellers_and_demographics(star):
    top = R.top_sellers(star, R.DEFAULT_AS_OF).collect()
    assert (top[0].first_name, top[0].total_orders, top[0].total_items_sold) == ("Supplier#000000079", 18, 494)
    assert top[0].total_revenue == pytest.approx(470309.6)
    d = R.customer_demographics(star, R.DEFAULT_AS_OF).first()
    assert d.total_customers == 188 and d.under_25 == 33 and d.age_25_35 == 48 and d.over_45 == 74
    assert d.average_age == pytest.approx(41.304452, abs=1e-6)


def test_revenue_totals_agree(star):
    a = R.DEFAULT_AS_OF
    q2 = sum(r.total_revenue for r in R.top_categories(star, a).collect())
    q6 = sum(r.daily_revenue for r in R.daily_sales_trend(star, a).collect())
    q13 = sum(r.seller_revenue for r in R.panel_revenue_by_seller(star, as_of=a).collect())
    assert q2 == pytest.approx(q6) and q2 == pytest.approx(q13)
    q4_orders = sum(r.total_orders for r in R.sales_metrics(star, a).collect())
    q15 = sum(r.total_orders for r in R.panel_daily_orders(star, as_of=a).collect())
    assert q15 <= q4_orders


def test_age_bucket_edges(spark):
    df = spark.createDataFrame([(24,), (25,), (35,), (36,), (45,), (46,), (None,)], "a int")
    got = [r[0] for r in df.select(R.age_bucket("a")).collect()]
    assert got == ["Under 25", "25-35", "25-35", "36-45", "36-45", "Over 45", "Over 45"]


def test_reports_push_date_filter_to_scan(star):
    plan = R.top_categories(star, R.DEFAULT_AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_more_golden_values(star):
    a = R.DEFAULT_AS_OF
    cats = {(str(r.month), r.main_category): r for r in R.mv_top_categories_month(star, a).collect()}
    assert len(cats) == 11
    e = cats[("2001-07-01", "ECONOMY")]
    assert (e.total_orders, e.unique_customers) == (127, 94) and e.total_revenue == pytest.approx(3158955.0)
    perf = {(r.product_name, r.main_category): r for r in R.product_performance(star, a).collect()}
    assert perf[("blue bolt", "MEDIUM")].total_orders == 9
    assert perf[("blue bolt", "MEDIUM")].total_revenue == pytest.approx(309680.5)
    dac = {str(r.time): r.total_customers for r in R.panel_daily_active_customers(star, as_of=a).collect()}
    assert dac["2001-07-01"] == 10 and dac["2001-07-02"] == 7
    import datetime as dt
    nu = R.panel_daily_new_users(star, frm=dt.datetime(1990, 1, 1), to=a).collect()
    assert len(nu) == 562 and {str(r.time): r.new_users for r in nu}["1995-01-01"] == 2
