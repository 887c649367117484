"""Incremental view maintenance of the month roll-ups by signed deltas.

The five roll-ups are sums and distinct counts over order lines. They are kept as one
counting table, the *cells*: lines ``n`` and units ``qty`` per (month, product,
seller, user). A change of rows is its old images with weight -1 and its new ones
with +1; for lines V = items x orders the change is

    dV = d(items) x old orders  +  new items x d(orders)

so a batch reads the touched orders and items only, and a deleted, moved or re-counted
row takes back exactly what it once gave. Cells add up over batches in any order. A
distinct count is the number of keys whose lines have not come down to zero, which a
plain running total could not take back. Prices, names and ages are joined when a
month's roll-ups are derived, so their changes touch no cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..plans import reports as R

CELL = ["month", "product_id", "seller_id", "user_id"]
_ITEM = ["order_id", "product_id", "seller_id", "quantity"]
_ORDER = ["order_id", "order_date", "user_id"]


def signed(old: DataFrame, new: DataFrame, cols) -> DataFrame:
    """Old images with weight -1 and new ones with +1; rows that are in both cancel out."""
    both = old.select(*cols, F.lit(-1).alias("w")).unionByName(new.select(*cols, F.lit(1).alias("w")))
    return both.groupBy(*cols).agg(F.sum("w").alias("w")).where("w <> 0")


def cells(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The cells of whole tables."""
    return weighted_cells(items.select(*_ITEM, F.lit(1).alias("w")), orders.select(*_ORDER, F.lit(1).alias("v")))


def weighted_cells(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Cells of items (weight w) x orders (weight v)."""
    lines = items.join(orders, "order_id").select(
        D.month_trunc("order_date").alias("month"), "product_id", "seller_id", "user_id",
        (F.col("w") * F.col("v")).cast("bigint").alias("n"),
        (F.col("w") * F.col("v") * F.col("quantity")).cast("bigint").alias("qty"))
    return added(lines)


def added(parts: DataFrame) -> DataFrame:
    """Cells summed up; those that cancel out are gone."""
    return parts.groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("qty").alias("qty")).where("n <> 0 OR qty <> 0")


def cell_changes(item_changes: DataFrame, order_changes: DataFrame, old_orders: DataFrame,
                 new_items: DataFrame) -> DataFrame:
    """dV for signed changes of items and orders.

    ``old_orders`` must hold the orders of the changed items before the change and
    ``new_items`` the items of the changed orders after it (further rows do no harm).
    """
    ids = item_changes.select("order_id").distinct()
    first = weighted_cells(item_changes, old_orders.join(ids, "order_id", "left_semi").select(*_ORDER, F.lit(1).alias("v")))
    ids = order_changes.select("order_id").distinct()
    second = weighted_cells(new_items.join(ids, "order_id", "left_semi").select(*_ITEM, F.lit(1).alias("w")),
                            order_changes.withColumnRenamed("w", "v"))
    return added(first.unionByName(second))


class CellRollups:
    """The five month roll-ups derived from cells; the same rows as the live reports give."""

    def __init__(self, cells: DataFrame, star):
        p = star.products().select("product_id", "external_price", "main_category")
        self.star = star
        self.lines = cells.where("n <> 0").join(p, "product_id").withColumn(
            "rev", F.col("qty") * F.col("external_price"))

    def totals(self, *keys: str) -> DataFrame:
        return self.lines.groupBy("month", *keys).agg(
            F.sum("n").alias("total_orders"), F.sum("qty").cast("bigint").alias("_qty"),
            F.count_distinct("user_id").alias("unique_customers"), F.sum("rev").alias("_rev"))

    def mv_top_sellers_month(self) -> DataFrame:
        return R.top_sellers_month_of(self.totals("seller_id"), self.star)

    def mv_top_categories_month(self) -> DataFrame:
        return R.top_categories_month_of(self.totals("main_category"))

    def mv_customer_demographics_month(self) -> DataFrame:
        spend = self.lines.groupBy("month", "user_id").agg(F.sum("n").alias("n"), F.sum("rev").alias("rev"))
        return R.customer_demographics_month_of(
            spend.join(self.star.users().select("user_id", "user_age"), "user_id"))

    def mv_sales_metrics_month(self) -> DataFrame:
        return R.sales_metrics_month_of(self.totals())

    def mv_product_performance_month(self) -> DataFrame:
        return R.product_performance_month_of(self.totals("product_id"), self.star)


ROLLUPS = ("mv_top_sellers_month", "mv_top_categories_month", "mv_customer_demographics_month",
           "mv_sales_metrics_month", "mv_product_performance_month")
