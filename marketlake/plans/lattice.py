"""The dashboard's eight panels from one stored aggregate lattice.

One pass over the window's order lines gives n, units and revenue per (day, category, seller); grouping
sets over that small table give the levels day, category and seller. Orders and users add their day
levels. All levels are rows of one table, ``level, day, main_category, seller_id`` and measures,
from which each panel is a filter and a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from . import reports as R

MEASURES = ["n", "qty", "rev", "users", "age"]


def build(star, as_of=None, frm=None, to=None) -> DataFrame:
    """The lattice of the window; write it once per refresh and derive the panels from it."""
    orders = R.window_orders(star, "range", as_of, frm, to).withColumn("day", D.day_trunc("order_date"))
    lines = R.per_product(star, orders.select("order_id", "day"), ["main_category"], ["day", "seller_id"])
    cells = lines.groupBy("day", "main_category", "seller_id").agg(
        F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.sum("rev").alias("rev"))
    cube = cells.groupingSets([("day",), ("main_category",), ("seller_id",)], "day", "main_category", "seller_id").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.sum("rev").alias("rev"))
    level = F.when(F.col("g") == 3, "day").when(F.col("g") == 5, "category").otherwise("seller")
    levels = [cube.select(level.alias("level"), "day", "main_category", "seller_id", "n", "qty",
                          F.col("rev").cast("decimal(38,2)").alias("rev"))]
    levels.append(orders.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
                  .select(F.lit("orders").alias("level"), "day", "n", "users"))
    if frm is None or to is None:
        frm, to = D.default_range(R._now(as_of))
    people = star.users(activity=True)
    seen = D.time_range_filter(people, "last_login", frm, to)
    levels.append(seen.groupBy(D.day_trunc("last_login").alias("day")).agg(F.avg("user_age").alias("age"))
                  .select(F.lit("logins").alias("level"), "day", "age"))
    new = D.time_range_filter(people, "date_joined", frm, to)
    levels.append(new.groupBy(D.day_trunc("date_joined").alias("day")).agg(F.count(F.lit(1)).alias("users"))
                  .select(F.lit("joined").alias("level"), "day", "users"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def panels(lattice: DataFrame, star) -> DataFrame:
    """(panel, day, name, value): the rows of all eight panels."""
    def panel(title: str, level: str, value, name=F.lit(None).cast("string")) -> DataFrame:
        return lattice.where(F.col("level") == level).select(
            F.lit(title).alias("panel"), "day", name.alias("name"), value.cast("double").alias("value"))

    s = star.sellers().select("seller_id", F.concat_ws(" ", "first_name", "last_name").alias("seller"))
    named = lattice.where("level = 'seller'").join(s, "seller_id")
    parts = [
        panel("daily_revenue", "day", F.col("rev")),
        panel("revenue_by_category", "category", F.col("rev"), F.col("main_category")),
        panel("daily_active_customers", "orders", F.col("users")),
        panel("daily_average_age", "logins", F.col("age")),
        *[named.select(F.lit(title).alias("panel"), "day", F.col("seller").alias("name"), F.col(c).cast("double").alias("value"))
          for title, c in (("revenue_by_seller", "rev"), ("items_by_seller", "qty"))],
        panel("daily_orders", "orders", F.col("n")),
        panel("daily_new_users", "joined", F.col("users")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
