"""Registered roll-ups by signed deltas (R6): the cells of the stored tables, brought up to date by
the changes of a made day's work, must give what the live reports give over the changed tables.

The changes follow from the keys (fixed rules below): orders are deleted, move to another day
or another customer; items change their quantity, move to another order or are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deltas as X
from ..sources.testdata import ORACLE_STAR_CTES, Star

# Fixed rules: key mod m = r chooses the rows each change meets.
DELETED_ORDERS, MOVED_ORDERS, SOLD_ON_ORDERS = (11, 3), (11, 5), (23, 7)
RECOUNTED_ITEMS, MOVED_ITEMS, DELETED_ITEMS = (13, 2), (17, 4), (19, 6)
MOVED_DAYS, MORE_UNITS = 40, 3


def _meets(key: Column, rule: tuple[int, int]) -> Column:
    return F.pmod(key, F.lit(rule[0])) == rule[1]


def changed_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old images, new images) of the orders that change."""
    oid = F.col("order_id")
    old = orders.where(_meets(oid, DELETED_ORDERS) | _meets(oid, MOVED_ORDERS) | _meets(oid, SOLD_ON_ORDERS))
    new = old.where(~_meets(oid, DELETED_ORDERS)).withColumns({
        "order_date": F.when(_meets(oid, MOVED_ORDERS), F.col("order_date") + F.make_dt_interval(F.lit(MOVED_DAYS)))
        .otherwise(F.col("order_date")),
        "user_id": F.when(_meets(oid, SOLD_ON_ORDERS), F.col("user_id") + 1).otherwise(F.col("user_id"))})
    return old, new


def changed_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old images, new images) of the items that change."""
    part = F.col("product_id")
    old = items.where(_meets(part, RECOUNTED_ITEMS) | _meets(part, MOVED_ITEMS) | _meets(part, DELETED_ITEMS))
    new = old.where(~_meets(part, DELETED_ITEMS)).withColumns({
        "quantity": F.when(_meets(part, RECOUNTED_ITEMS), F.col("quantity") + MORE_UNITS).otherwise(F.col("quantity")),
        "order_id": F.when(_meets(part, MOVED_ITEMS), F.col("order_id") + 1).otherwise(F.col("order_id"))})
    return old, new


def rollups_after_changes(spark: SparkSession, sf_dir: str) -> X.CellRollups:
    """Roll-ups from the stored cells and the changed ones; no whole table is joined again."""
    star = Star(spark, sf_dir)
    items, orders = star.order_items().select(*X._ITEM), star.orders().select(*X._ORDER)
    old_orders, new_orders = changed_orders(orders)
    old_items, new_items = changed_items(items)
    order_changes = X.signed(old_orders, new_orders, X._ORDER)
    # the items after the change, of the changed orders: those that stay as they were, and the new images
    kept = items.where(~(_meets(F.col("product_id"), RECOUNTED_ITEMS) | _meets(F.col("product_id"), MOVED_ITEMS)
                         | _meets(F.col("product_id"), DELETED_ITEMS)))
    changes = X.cell_changes(X.signed(old_items, new_items, X._ITEM), order_changes, orders, kept.unionByName(new_items))
    return X.CellRollups(X.added(X.cells(items, orders).unionByName(changes)), star)


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(rollups_after_changes(spark, sf_dir), name)()
    run.__name__ = name.replace("mv_", "delta_")
    return run


DELTA_QUERIES = {name.replace("mv_", "delta_"): _query(name) for name in X.ROLLUPS}

_CHANGED = f"""WITH {ORACLE_STAR_CTES},
  o2 AS (SELECT order_id, order_date + CASE WHEN order_id % 11 = 5 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS order_date,
                user_id + CASE WHEN order_id % 23 = 7 THEN 1 ELSE 0 END AS user_id
         FROM o WHERE order_id % 11 <> 3),
  i2 AS (SELECT order_id + CASE WHEN product_id % 17 = 4 THEN 1 ELSE 0 END AS order_id, product_id, seller_id,
                quantity + CASE WHEN product_id % 13 = 2 THEN 3 ELSE 0 END AS quantity
         FROM oi WHERE product_id % 19 <> 6),
  sold AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, i2.*, user_id, p.* EXCLUDE (product_id),
                  quantity * external_price AS money
           FROM i2 JOIN o2 USING (order_id) JOIN p USING (product_id))
"""
_N, _UNITS, _MONEY, _BUYERS = ("count(*)", "CAST(sum(quantity) AS BIGINT)", "CAST(sum(money) AS DOUBLE)",
                               "count(DISTINCT user_id)")

DELTA_SQL = {
    "delta_top_sellers_month": f"""{_CHANGED}
SELECT month, seller_id, any_value(first_name) AS seller_first_name, any_value(last_name) AS seller_last_name,
       {_N} AS total_orders, {_UNITS} AS total_items_sold, {_BUYERS} AS unique_customers, {_MONEY} AS total_revenue,
       {_MONEY} / {_N} AS average_order_value
FROM sold JOIN s USING (seller_id) GROUP BY month, seller_id""",
    "delta_top_categories_month": f"""{_CHANGED}
SELECT month, main_category, {_N} AS total_orders, {_UNITS} AS total_quantity_sold, {_BUYERS} AS unique_customers,
       {_MONEY} AS total_revenue, {_MONEY} / {_N} AS average_order_value
FROM sold GROUP BY month, main_category""",
    "delta_customer_demographics_month": f"""{_CHANGED}, buyer AS (
  SELECT month, user_id, any_value(user_age) AS age, count(*) AS lines, sum(money) AS spent
  FROM sold JOIN u USING (user_id) GROUP BY month, user_id)
SELECT month, CAST(sum(age * lines) AS DOUBLE) / CAST(sum(lines) AS DOUBLE) AS average_customer_age,
       count(*) AS total_customers, CAST(sum(spent) AS DOUBLE) / count(*) AS average_customer_spend,
       count(*) FILTER (age < 25) AS customers_under_25, count(*) FILTER (age BETWEEN 25 AND 35) AS customers_25_35,
       count(*) FILTER (age BETWEEN 36 AND 45) AS customers_36_45, count(*) FILTER (age > 45) AS customers_over_45,
       CAST(sum(spent) AS DOUBLE) AS total_revenue
FROM buyer GROUP BY month""",
    "delta_sales_metrics_month": f"""{_CHANGED}
SELECT month, {_N} AS total_orders, {_UNITS} AS total_items_sold, {_BUYERS} AS unique_customers, {_MONEY} AS total_revenue,
       {_MONEY} / {_N} AS average_order_value, {_MONEY} / {_BUYERS} AS revenue_per_customer,
       CAST(sum(quantity) AS DOUBLE) / {_N} AS average_items_per_order
FROM sold GROUP BY month""",
    "delta_product_performance_month": f"""{_CHANGED}
SELECT month, product_id, any_value(product_name) AS product_name, any_value(main_category) AS main_category,
       any_value(sub_category) AS sub_category, {_N} AS total_orders, {_UNITS} AS total_quantity_sold,
       {_BUYERS} AS unique_customers, {_MONEY} AS total_revenue, {_MONEY} / {_N} AS average_selling_price
FROM sold GROUP BY month, product_id""",
}
