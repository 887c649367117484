"""Named analytics reports Q1-Q21 over the star schema.

Metric definitions follow the reference's report SQL exactly (B4/B5 kept):
``count()`` after the item join counts item rows, revenue is
quantity x current catalog price, and no status filter is added.

Plan shape, chosen for a fact table of billions of rows:

* The time filter is applied to ``orders`` before the join, with a literal
  of the column's type, so it is a parquet ``PushedFilter``; the runtime
  bloom filter built from the filtered orders then prunes ``order_items``
  before it is shuffled for the join.
* Reports keyed by product attributes (category, product name) aggregate the
  joined lines on ``product_id`` first and join ``products`` afterwards:
  revenue = price x sum(quantity) per product is exact in decimal, the join
  sees one row per product instead of one per line, and a product holding a
  third of all lines is collapsed by the map-side partial aggregate.
* Seller reports aggregate on ``seller_id`` before joining the seller
  names, for the same reason.
* Money is summed in decimal (exact, order independent) and turned into
  double only at the end; ratios divide those doubles by integer counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D

# Fixed value: the dashboard's "now" for the TESTDATA star (last order day).
DEFAULT_AS_OF = dt.datetime(2001, 8, 1)


# ---------------------------------------------------------------- helpers --
def _now(as_of):
    return as_of if as_of is not None else dt.datetime.now().replace(microsecond=0)


def window_orders(star, mode: str, as_of=None, frm=None, to=None) -> DataFrame:
    """Orders restricted by one of the report time windows.

    mode: ``rolling`` (P5), ``range`` (P6, default now-1M..now) or
    ``calendar`` (P7).
    """
    o = star.orders().select("order_id", "order_date", "user_id")
    as_of = _now(as_of)
    if mode == "rolling":
        return D.rolling_month_filter(o, "order_date", as_of)
    if mode == "calendar":
        return D.calendar_month_filter(o, "order_date", as_of)
    if mode == "range":
        if frm is None or to is None:
            frm, to = D.default_range(as_of)
        return D.time_range_filter(o, "order_date", frm, to)
    raise ValueError(f"unknown window mode {mode!r}")


def order_lines(star, orders: DataFrame) -> DataFrame:
    """J1 (first half): filtered orders x order items, inner."""
    items = star.order_items().select("order_id", "product_id", "seller_id", "quantity")
    return items.join(orders, "order_id", "inner")


def priced_lines(star, orders: DataFrame, product_cols=()) -> DataFrame:
    """Lines x products (inner) with ``revenue`` = quantity x price."""
    p = star.products().select("product_id", "external_price", *product_cols)
    return (
        order_lines(star, orders)
        .join(p, "product_id", "inner")
        .withColumn("revenue", F.col("quantity") * F.col("external_price"))
    )


def per_product(star, orders: DataFrame, product_cols=(), keys=()) -> DataFrame:
    """Lines aggregated on (keys, product_id), then joined with products.

    Returns keys, product_cols, ``n`` (item rows), ``qty``, ``rev`` (decimal).
    """
    agg = order_lines(star, orders).groupBy(*keys, "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("qty")
    )
    p = star.products().select("product_id", "external_price", *product_cols)
    return agg.join(p, "product_id", "inner").select(
        *keys, "product_id", *product_cols, "n", "qty",
        (F.col("qty") * F.col("external_price")).alias("rev"),
    )


def totals(star, orders: DataFrame, *keys: str) -> DataFrame:
    """``n``, ``qty`` and ``rev`` per keys; lines meet products only once summed per product."""
    return per_product(star, orders, keys=keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.sum("rev").alias("rev"))


def _dbl(c) -> Column:
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def _ratio(num: Column, den: Column) -> Column:
    """Double quotient, null when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def age_bucket(age) -> Column:
    """Under 25 / 25-35 / 36-45 / Over 45 (null falls to Over 45)."""
    a = F.col(age) if isinstance(age, str) else age
    return (
        F.when(a < 25, "Under 25")
        .when(a.between(25, 35), "25-35")
        .when(a.between(36, 45), "36-45")
        .otherwise("Over 45")
    )


def _bucket_counts(age: Column, prefix: str = "") -> list[Column]:
    # count_if over per-user rows == count(DISTINCT CASE WHEN p THEN user END)
    return [
        F.count_if(age < 25).alias(f"{prefix}under_25"),
        F.count_if(age.between(25, 35)).alias(f"{prefix}25_35" if prefix else "age_25_35"),
        F.count_if(age.between(36, 45)).alias(f"{prefix}36_45" if prefix else "age_36_45"),
        F.count_if(age > 45).alias(f"{prefix}over_45"),
    ]


def per_user(star, orders: DataFrame, keys=()) -> DataFrame:
    """Spend per (keys, user): item rows ``n`` and decimal ``rev``, with age.

    One shuffle on the user key; every later aggregate (bucket counts,
    distinct customers) runs over one row per user instead of per line.
    """
    lines = priced_lines(star, orders)
    spend = lines.groupBy(*keys, "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("rev")
    )
    users = star.users().select("user_id", "user_age")
    return spend.join(users, "user_id", "inner")


# --------------------------------------------------------------- Q1 - Q8 ---
def top_sellers(star, as_of=None, k: int = 10) -> DataFrame:
    """Q1: sellers (merged by name) ranked by revenue, top k."""
    by_seller = totals(star, window_orders(star, "rolling", as_of), "seller_id")
    named = by_seller.join(star.sellers(), "seller_id", "inner")
    agg = named.groupBy("first_name", "last_name").agg(
        F.sum("n").alias("total_orders"),
        F.sum("qty").cast("bigint").alias("total_items_sold"),
        F.sum("rev").alias("_rev"),
    )
    return (
        agg.orderBy(F.desc("_rev"), "first_name", "last_name")
        .limit(k)
        .select("first_name", "last_name", "total_orders", "total_items_sold",
                _dbl("_rev").alias("total_revenue"))
    )


def top_categories(star, as_of=None) -> DataFrame:
    """Q2: per main category: item rows, quantity, revenue; revenue desc."""
    pp = per_product(star, window_orders(star, "rolling", as_of), ["main_category"])
    agg = pp.groupBy("main_category").agg(
        F.sum("n").alias("total_orders"),
        F.sum("qty").cast("bigint").alias("total_quantity_sold"),
        F.sum("rev").alias("_rev"),
    )
    return agg.orderBy(F.desc("_rev"), "main_category").select(
        "main_category", "total_orders", "total_quantity_sold", _dbl("_rev").alias("total_revenue")
    )


def customer_demographics(star, as_of=None) -> DataFrame:
    """Q3: one row: line-weighted mean age, customers, spend, age buckets."""
    pu = per_user(star, window_orders(star, "rolling", as_of))
    age = F.col("user_age")
    return pu.agg(
        _ratio(F.sum(age * F.col("n")), F.sum("n")).alias("average_age"),
        F.count(F.lit(1)).alias("total_customers"),
        _ratio(F.sum("rev"), F.count(F.lit(1))).alias("average_spend"),
        *_bucket_counts(age),
    )


def _daily_totals(star, orders: DataFrame) -> DataFrame:
    return totals(star, orders.withColumn("time", D.day_trunc("order_date")), "time")


def sales_metrics(star, as_of=None) -> DataFrame:
    """Q4: per day: item rows, quantity, revenue, mean line value."""
    agg = _daily_totals(star, window_orders(star, "rolling", as_of)).select(
        "time", F.col("n").alias("total_orders"), F.col("qty").cast("bigint").alias("total_items_sold"),
        F.col("rev").alias("_rev"))
    return agg.orderBy("time").select(
        "time", "total_orders", "total_items_sold", _dbl("_rev").alias("total_revenue"),
        _ratio(F.col("_rev"), F.col("total_orders")).alias("average_order_value"),
    )


def product_performance(star, as_of=None, k: int = 10) -> DataFrame:
    """Q5: per (product name, main category), top k by revenue."""
    pp = per_product(star, window_orders(star, "rolling", as_of), ["product_name", "main_category"])
    agg = pp.groupBy("product_name", "main_category").agg(
        F.sum("n").alias("total_orders"),
        F.sum("qty").cast("bigint").alias("total_quantity_sold"),
        F.sum("rev").alias("_rev"),
    )
    return (
        agg.orderBy(F.desc("_rev"), "product_name", "main_category")
        .limit(k)
        .select("product_name", "main_category", "total_orders", "total_quantity_sold",
                _dbl("_rev").alias("total_revenue"))
    )


def daily_sales_trend(star, as_of=None) -> DataFrame:
    """Q6: per day: revenue, item rows, quantity."""
    agg = _daily_totals(star, window_orders(star, "rolling", as_of)).select(
        "time", F.col("rev").alias("_rev"), F.col("n").alias("daily_orders"),
        F.col("qty").cast("bigint").alias("daily_items_sold"))
    return agg.orderBy("time").select(
        "time", _dbl("_rev").alias("daily_revenue"), "daily_orders", "daily_items_sold"
    )


def category_distribution(star, as_of=None) -> DataFrame:
    """Q7: per category: distinct orders, items, revenue, share of revenue.

    The share divides by the total over the aggregated categories (W2), a
    window over one row per category, never over lines.
    """
    lines = priced_lines(star, window_orders(star, "rolling", as_of), ["main_category"])
    agg = lines.groupBy("main_category").agg(
        F.count_distinct("order_id").alias("order_count"),
        F.sum("quantity").cast("bigint").alias("items_sold"),
        F.sum("revenue").alias("_rev"),
    )
    total = F.sum("_rev").over(Window.partitionBy())
    return agg.select(
        "main_category", "order_count", "items_sold", _dbl("_rev").alias("category_revenue"),
        (F.try_divide(_dbl("_rev"), total.cast("double")) * F.lit(100.0)).alias("revenue_percentage"),
        F.col("_rev"),
    ).orderBy(F.desc("_rev"), "main_category").drop("_rev")


def customer_age_distribution(star, as_of=None) -> DataFrame:
    """Q8: per age group: customers, revenue, mean line value."""
    pu = per_user(star, window_orders(star, "rolling", as_of))
    agg = pu.groupBy(age_bucket("user_age").alias("age_group")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum("rev").alias("_rev"),
        F.sum("n").alias("_n"),
    )
    return agg.orderBy(F.desc("customer_count"), "age_group").select(
        "age_group", "customer_count", _dbl("_rev").alias("group_revenue"),
        _ratio(F.col("_rev"), F.col("_n")).alias("average_spend"),
    )


# ---------------------------------------------------- Q9 - Q16 (panels) ----
def panel_daily_revenue(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q9: revenue per day inside [frm, to]."""
    d = _daily_totals(star, window_orders(star, "range", as_of, frm, to))
    return d.select("time", _dbl("rev").alias("daily_revenue")).orderBy("time")


def panel_revenue_by_category(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q10: revenue per main category inside [frm, to] (unordered)."""
    pp = per_product(star, window_orders(star, "range", as_of, frm, to), ["main_category"])
    return pp.groupBy("main_category").agg(_dbl(F.sum("rev")).alias("category_revenue"))


def panel_daily_active_customers(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q11: distinct ordering users per day (orders only)."""
    o = window_orders(star, "range", as_of, frm, to)
    return (
        o.groupBy(D.day_trunc("order_date").alias("time"))
        .agg(F.count_distinct("user_id").alias("total_customers"))
        .orderBy("time")
    )


def panel_daily_average_age(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q12: mean user age per day of last login."""
    u = star.users(activity=True).select("user_id", "user_age", "last_login")
    if frm is None or to is None:
        frm, to = D.default_range(_now(as_of))
    u = D.time_range_filter(u, "last_login", frm, to)
    return (
        u.groupBy(D.day_trunc("last_login").alias("time"))
        .agg(_ratio(F.sum("user_age"), F.count("user_age")).alias("average_age"))
        .orderBy("time")
    )


def panel_revenue_by_seller(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q13: revenue per seller id (named first last), desc."""
    t = totals(star, window_orders(star, "range", as_of, frm, to), "seller_id")
    named = t.join(star.sellers(), "seller_id", "inner")
    return named.orderBy(F.desc("rev"), "seller_id").select(
        F.concat_ws(" ", "first_name", "last_name").alias("seller_name"),
        _dbl("rev").alias("seller_revenue"),
    )


def panel_items_by_seller(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q14: quantity per seller id; products joined as an existence filter."""
    lines = order_lines(star, window_orders(star, "range", as_of, frm, to))
    per_pair = lines.groupBy("seller_id", "product_id").agg(F.sum("quantity").alias("qty"))
    kept = per_pair.join(star.products().select("product_id"), "product_id", "inner")
    t = kept.groupBy("seller_id").agg(F.sum("qty").cast("bigint").alias("items_sold"))
    named = t.join(star.sellers(), "seller_id", "inner")
    return named.orderBy(F.desc("items_sold"), "seller_id").select(
        F.concat_ws(" ", "first_name", "last_name").alias("seller_name"), "items_sold"
    )


def panel_daily_orders(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q15: true order count per day (no item join)."""
    o = window_orders(star, "range", as_of, frm, to)
    return (
        o.groupBy(D.day_trunc("order_date").alias("time"))
        .agg(F.count(F.lit(1)).alias("total_orders"))
        .orderBy("time")
    )


def panel_daily_new_users(star, frm=None, to=None, as_of=None) -> DataFrame:
    """Q16: users per day of date_joined."""
    u = star.users(activity=True).select("user_id", "date_joined")
    if frm is None or to is None:
        frm, to = D.default_range(_now(as_of))
    u = D.time_range_filter(u, "date_joined", frm, to)
    return (
        u.groupBy(D.day_trunc("date_joined").alias("time"))
        .agg(F.count(F.lit(1)).alias("new_users"))
        .orderBy("time")
    )


# ------------------------------------------------ Q17 - Q21 (month roll-ups)
def _monthly_lines(star, as_of, product_cols=()) -> DataFrame:
    o = window_orders(star, "calendar", as_of).withColumn("month", D.month_trunc("order_date"))
    return priced_lines(star, o.select("order_id", "user_id", "month"), product_cols)


def _roll_metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("quantity").cast("bigint").alias("_qty"),
        F.count_distinct("user_id").alias("unique_customers"),
        F.sum("revenue").alias("_rev"),
    ]


def _monthly_totals(star, as_of, *keys: str) -> DataFrame:
    """The roll-up metrics per month and keys, from lines summed per user and product first."""
    o = window_orders(star, "calendar", as_of).withColumn("month", D.month_trunc("order_date"))
    keys = ("month", *keys)
    per = per_product(star, o.select("order_id", "user_id", "month"), keys=(*keys, "user_id"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("total_orders"), F.sum("qty").cast("bigint").alias("_qty"),
        F.count_distinct("user_id").alias("unique_customers"), F.sum("rev").alias("_rev"))


def mv_top_sellers_month(star, as_of=None) -> DataFrame:
    """Q17: per month and seller: rows, items, customers, revenue, mean."""
    return top_sellers_month_of(_monthly_totals(star, as_of, "seller_id"), star)


def top_sellers_month_of(totals: DataFrame, star) -> DataFrame:
    """Q17's columns from the totals per month and seller."""
    return totals.join(star.sellers(), "seller_id", "inner").select(
        "month", "seller_id",
        F.col("first_name").alias("seller_first_name"),
        F.col("last_name").alias("seller_last_name"),
        "total_orders", F.col("_qty").alias("total_items_sold"), "unique_customers",
        _dbl("_rev").alias("total_revenue"),
        _ratio(F.col("_rev"), F.col("total_orders")).alias("average_order_value"),
    )


def mv_top_categories_month(star, as_of=None) -> DataFrame:
    """Q18: per month and main category."""
    agg = _monthly_lines(star, as_of, ["main_category"]).groupBy("month", "main_category").agg(
        *_roll_metrics()
    )
    return top_categories_month_of(agg)


def top_categories_month_of(totals: DataFrame) -> DataFrame:
    """Q18's columns from the totals per month and main category."""
    return totals.select(
        "month", "main_category", "total_orders", F.col("_qty").alias("total_quantity_sold"),
        "unique_customers", _dbl("_rev").alias("total_revenue"),
        _ratio(F.col("_rev"), F.col("total_orders")).alias("average_order_value"),
    )


def mv_customer_demographics_month(star, as_of=None) -> DataFrame:
    """Q19: Q3's metrics per month, plus revenue."""
    o = window_orders(star, "calendar", as_of).withColumn("month", D.month_trunc("order_date"))
    return customer_demographics_month_of(per_user(star, o.select("order_id", "user_id", "month"), keys=["month"]))


def customer_demographics_month_of(spend: DataFrame) -> DataFrame:
    """Q19's columns from one row per month and user: ``n``, ``rev``, ``user_age``."""
    age = F.col("user_age")
    agg = spend.groupBy("month").agg(
        _ratio(F.sum(age * F.col("n")), F.sum("n")).alias("average_customer_age"),
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("rev").alias("_rev"),
        *_bucket_counts(age, prefix="customers_"),
    )
    return agg.select(
        "month", "average_customer_age", "total_customers",
        _ratio(F.col("_rev"), F.col("total_customers")).alias("average_customer_spend"),
        "customers_under_25", "customers_25_35", "customers_36_45", "customers_over_45",
        _dbl("_rev").alias("total_revenue"),
    )


def mv_sales_metrics_month(star, as_of=None) -> DataFrame:
    """Q20: per month: rows, items, customers, revenue, means."""
    return sales_metrics_month_of(_monthly_totals(star, as_of))


def sales_metrics_month_of(totals: DataFrame) -> DataFrame:
    """Q20's columns from the totals per month."""
    return totals.select(
        "month", "total_orders", F.col("_qty").alias("total_items_sold"), "unique_customers",
        _dbl("_rev").alias("total_revenue"),
        _ratio(F.col("_rev"), F.col("total_orders")).alias("average_order_value"),
        _ratio(F.col("_rev"), F.col("unique_customers")).alias("revenue_per_customer"),
        _ratio(F.col("_qty"), F.col("total_orders")).alias("average_items_per_order"),
    )


def mv_product_performance_month(star, as_of=None) -> DataFrame:
    """Q21: per month and product id (with name and categories)."""
    lines = _monthly_lines(star, as_of)
    return product_performance_month_of(lines.groupBy("month", "product_id").agg(*_roll_metrics()), star)


def product_performance_month_of(totals: DataFrame, star) -> DataFrame:
    """Q21's columns from the totals per month and product."""
    p = star.products().select("product_id", "product_name", "main_category", "sub_category")
    return totals.join(p, "product_id", "inner").select(
        "month", "product_id", "product_name", "main_category", "sub_category",
        "total_orders", F.col("_qty").alias("total_quantity_sold"), "unique_customers",
        _dbl("_rev").alias("total_revenue"),
        _ratio(F.col("_rev"), F.col("total_orders")).alias("average_selling_price"),
    )


REPORTS = {
    "top_sellers": top_sellers,
    "top_categories": top_categories,
    "customer_demographics": customer_demographics,
    "sales_metrics": sales_metrics,
    "product_performance": product_performance,
    "daily_sales_trend": daily_sales_trend,
    "category_distribution": category_distribution,
    "customer_age_distribution": customer_age_distribution,
    "panel_daily_revenue": panel_daily_revenue,
    "panel_revenue_by_category": panel_revenue_by_category,
    "panel_daily_active_customers": panel_daily_active_customers,
    "panel_daily_average_age": panel_daily_average_age,
    "panel_revenue_by_seller": panel_revenue_by_seller,
    "panel_items_by_seller": panel_items_by_seller,
    "panel_daily_orders": panel_daily_orders,
    "panel_daily_new_users": panel_daily_new_users,
    "mv_top_sellers_month": mv_top_sellers_month,
    "mv_top_categories_month": mv_top_categories_month,
    "mv_customer_demographics_month": mv_customer_demographics_month,
    "mv_sales_metrics_month": mv_sales_metrics_month,
    "mv_product_performance_month": mv_product_performance_month,
}
