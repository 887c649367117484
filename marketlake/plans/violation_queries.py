"""Registered query of the maintained violations (K1-K5): three states of the tables, two batches between them.

The states follow from the keys by fixed rules; the oracle checks the last state as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import violations as V
from ..session import durable_cut
from ..sources.testdata import Star


def _items(star: Star, parts: int) -> DataFrame:
    """Items with a key of their own, some with impossible quantities, without a seller, or twice in their order."""
    li = star.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.repartition(parts, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("product_id"), F.min("l_suppkey").alias("seller_id"),
        F.min(F.col("l_quantity").cast("int")).alias("quantity"))
    odd = F.col("product_id")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("item_id"), F.col("l_orderkey").alias("order_id"),
        F.when(odd % 23 == 4, 4).otherwise(odd).cast("bigint").alias("product_id"),
        F.when(odd % 43 == 0, None).when(odd % 23 == 4, 1).otherwise(F.col("seller_id")).cast("bigint").alias("seller_id"),
        F.when(odd % 41 == 0, 500).otherwise(F.col("quantity")).alias("quantity"))


def violations_after_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K5 kept by changed keys: orders go, quantities are repaired, items move; then orders come back, sellers go, items go."""
    star = Star(spark, sf_dir)
    orders, sellers = star.orders().select("order_id"), star.sellers().select("seller_id")
    parts = V.tasks(spark, star.raw("lineitem").count())  # a count from the files' footers
    items = durable_cut(_items(star, parts))
    kept = durable_cut(V.check(items, orders, sellers, parts))

    gone = "order_id % 17 = 5"
    old = items.where("(product_id % 41 = 0 AND order_id % 2 = 0) OR product_id % 37 = 1")
    new = old.withColumns({"quantity": F.when(F.expr("product_id % 41 = 0 AND order_id % 2 = 0"), 1).otherwise(F.col("quantity")),
                           "order_id": F.when(F.expr("product_id % 37 = 1"), F.col("order_id") + 1).otherwise(F.col("order_id"))})
    items_1 = durable_cut(items.join(old.select("item_id"), "item_id", "left_anti").unionByName(new))
    orders_1 = orders.where(f"NOT ({gone})")
    kept = durable_cut(V.maintain(kept, items_1, orders_1, sellers, old, new, orders.where(gone), sellers.limit(0), parts))

    orders_2 = orders.where(f"NOT ({gone}) OR order_id % 34 = 5")
    sellers_2 = sellers.where("seller_id % 7 <> 2")
    old = items_1.where("product_id % 19 = 3")
    items_2 = items_1.where("product_id % 19 <> 3")
    return V.maintain(kept, items_2, orders_2, sellers_2, old, old.limit(0), orders.where("order_id % 34 = 5"),
                      sellers.where("seller_id % 7 = 2"), parts)


VIOLATION_QUERIES = {"violations_after_batches": violations_after_batches}

VIOLATION_SQL = {"violations_after_batches": """
WITH li AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s,
                   min(CAST(trunc(l_quantity) AS INTEGER)) AS q FROM lineitem GROUP BY 1, 2),
  a AS (SELECT o * 100 + n AS item_id, o AS order_id, CASE WHEN p % 23 = 4 THEN 4 ELSE p END AS product_id,
               CASE WHEN p % 43 = 0 THEN NULL WHEN p % 23 = 4 THEN 1 ELSE s END AS seller_id,
               CASE WHEN p % 41 = 0 THEN 500 ELSE q END AS quantity FROM li),
  i AS (SELECT item_id, order_id + CASE WHEN product_id % 37 = 1 THEN 1 ELSE 0 END AS order_id, product_id, seller_id,
               CASE WHEN product_id % 41 = 0 AND order_id % 2 = 0 THEN 1 ELSE quantity END AS quantity
        FROM a WHERE product_id % 19 <> 3),
  o AS (SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey % 17 <> 5 OR o_orderkey % 34 = 5),
  s AS (SELECT s_suppkey AS seller_id FROM supplier WHERE s_suppkey % 7 <> 2)
SELECT 'duplicate_line' AS rule, item_id FROM i WHERE seller_id IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY order_id, product_id, seller_id) > 1
UNION ALL SELECT 'orphan_order', item_id FROM i WHERE order_id NOT IN (SELECT order_id FROM o)
UNION ALL SELECT 'orphan_seller', item_id FROM i WHERE seller_id IS NOT NULL AND seller_id NOT IN (SELECT seller_id FROM s)
UNION ALL SELECT 'missing_seller', item_id FROM i WHERE seller_id IS NULL
UNION ALL SELECT 'quantity_out_of_range', item_id FROM i WHERE quantity NOT BETWEEN 1 AND 100"""}
