"""Registered queries in which the refusing branch is taken (P10, J8, J15, U9, U11, U12), W5 over sparse
keys, P9 by gram index, and the panel lattice.

Requests follow from the tables by fixed rules: some name keys that do not exist, some another user's order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as CAT
from ..operators import lookups as L
from ..operators import orders as ORD
from ..operators import trigrams as T
from ..session import durable_cut, ensure_checkpoint_dir
from ..sources.catalog import ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star
from . import lattice as LA
from . import reports as R
from .oracle_reports import REPORT_SQL

FAR = 10 ** 9  # beyond every key


def customer_lookup_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: events' users, every seventh a key that does not exist."""
    star = Star(spark, sf_dir)
    asked = F.when(F.pmod("event_id", F.lit(7)) == 0, F.col("user_id") + FAR).otherwise(F.col("user_id"))
    req = star.raw("events").select("event_id", asked.alias("user_id"))
    return L.point_lookup(req, star.users().select("user_id", "first_name"), "user_id", ["first_name"])


def order_lines_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for unknown variants, variants of unknown products, products of unknown sellers and
    impossible quantities, checked line by line."""
    star = Star(spark, sf_dir)
    cat = Catalog(star)
    li = star.raw("lineitem")
    k = F.col("l_orderkey")
    lines = li.select(
        k.alias("request_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("line_key"),
        F.when(F.pmod(k, F.lit(31)) == 3, F.col("l_partkey") + FAR).otherwise(F.col("l_partkey")).alias("variant_id"),
        F.when(F.pmod(k, F.lit(29)) == 5, F.lit(0)).otherwise(F.col("l_quantity").cast("int")).alias("quantity"))
    products = cat.products().where(F.pmod("product_id", F.lit(101)) != 7)
    sellers = star.sellers().where(F.pmod("seller_id", F.lit(13)) != 4)
    out = ORD.lookup_lines(lines, star.variants(), products, sellers)
    error = F.coalesce("lookup_error", F.when(~F.col("quantity").between(ORD.MIN_QTY, ORD.MAX_QTY), F.lit("quantity out of range")))
    return out.groupBy("request_id", error.alias("error")).agg(F.count(F.lit(1)).alias("lines"))


def payments_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments by other users, for unknown orders and by a method that is not taken."""
    star = Star(spark, sf_dir)
    oid, uid = F.col("order_id"), F.col("user_id")
    req = star.orders().select(
        F.when(F.pmod(oid, F.lit(14)) == 3, oid + FAR).otherwise(oid).alias("order_id"),
        F.when(F.pmod(oid, F.lit(9)) == 2, uid + 1).otherwise(uid).alias("user_id"),
        F.when(F.pmod(oid, F.lit(5)) == 1, F.lit("cash")).otherwise(F.lit("card")).alias("method"))
    p = ORD.apply_payments(req, star.orders().select("order_id", "user_id", "total_amount"))
    return p.select("order_id", "user_id", "method", F.col("amount").cast("double").alias("amount"), "status",
                    "transaction_id", "order_status", "reject_reason")


def order_details_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order is asked for by another user, who sees nothing of it."""
    star = Star(spark, sf_dir)
    orders = star.orders().select("order_id", "user_id", "status")
    asked = F.when(F.pmod("order_id", F.lit(3)) == 1, F.col("user_id") + 1).otherwise(F.col("user_id"))
    items = star.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_partkey").alias("variant_id"),
        F.col("l_suppkey").alias("seller_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    d = ORD.order_detail(orders.select("order_id", asked.alias("user_id")), orders, items, star.products(), star.variants())
    return d.groupBy("order_id", "user_id", "status").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units"))


def round_robin_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in order of key to a list of sellers in order of key; neither's keys are dense."""
    star = Star(spark, sf_dir)
    sellers = star.raw("supplier").where("s_nationkey % 3 <> 1").select(F.col("s_suppkey").alias("seller_id"))
    items = star.raw("part").where("p_size % 4 <> 2").select(F.col("p_partkey").alias("product_id"))
    return CAT.round_robin(items, "product_id", sellers, "seller_id")


def _products_text(star: Star) -> DataFrame:
    p = Catalog(star).products()
    return p.select(F.col("product_id").alias("id"), F.concat_ws(" ", "product_name", "description").alias("text"))


def products_by_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many products' texts contain each of many substrings, by the gram index."""
    star = Star(spark, sf_dir)
    texts = durable_cut(_products_text(star))
    name = F.col("p_name")
    some = F.array(F.substring(name, 1, 1), F.substring(name, 2, 2), F.substring(name, 3, 4), F.upper(F.substring(name, 2, 6)),
                   F.concat(F.substring(name, 1, 3), F.lit("zq")))
    patterns = star.raw("part").where("p_partkey % 50 = 1").select(F.explode(some).alias("pattern")).distinct()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/grams-{uuid.uuid4().hex}"
    hits = T.build(texts, path).search(patterns, texts)
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("products"), F.min("doc_id").alias("first_product"))


def dashboard_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight panels from one stored lattice."""
    star = Star(spark, sf_dir)
    return LA.panels(durable_cut(LA.build(star, R.DEFAULT_AS_OF)), star)


REFUSAL_QUERIES = {f.__name__: f for f in (
    customer_lookup_refused, order_lines_refused, payments_refused, order_details_refused, round_robin_sellers,
    products_by_substring, dashboard_panels)}

# panel -> (registered report, its day column, its name column, its value column)
PANELS = {
    "daily_revenue": ("panel_daily_revenue", "time", None, "daily_revenue"),
    "revenue_by_category": ("panel_revenue_by_category", None, "main_category", "category_revenue"),
    "daily_active_customers": ("panel_daily_active_customers", "time", None, "total_customers"),
    "daily_average_age": ("panel_daily_average_age", "time", None, "average_age"),
    "revenue_by_seller": ("panel_revenue_by_seller", None, "seller_name", "seller_revenue"),
    "items_by_seller": ("panel_items_by_seller", None, "seller_name", "items_sold"),
    "daily_orders": ("panel_daily_orders", "time", None, "total_orders"),
    "daily_new_users": ("panel_daily_new_users", "time", None, "new_users"),
}

REFUSAL_SQL = {
    "customer_lookup_refused": f"""
SELECT e.event_id, e.user_id, c.c_name AS first_name, c.c_custkey IS NOT NULL AS found
FROM (SELECT event_id, user_id + CASE WHEN event_id % 7 = 0 THEN {FAR} ELSE 0 END AS user_id FROM events) e
LEFT JOIN customer c ON c.c_custkey = e.user_id""",
    "order_lines_refused": f"""
WITH line AS (SELECT l_orderkey AS request_id, l_partkey + CASE WHEN l_orderkey % 31 = 3 THEN {FAR} ELSE 0 END AS variant_id,
                     CASE WHEN l_orderkey % 29 = 5 THEN 0 ELSE CAST(trunc(l_quantity) AS INTEGER) END AS quantity FROM lineitem),
  pr AS (SELECT p_partkey AS product_id, p_partkey % (SELECT count(*) FROM supplier) AS seller_id FROM part WHERE p_partkey % 101 <> 7)
SELECT request_id, CASE WHEN p.p_partkey IS NULL THEN 'variant not found' WHEN pr.product_id IS NULL THEN 'product not found'
                        WHEN s.s_suppkey IS NULL THEN 'seller not found'
                        WHEN quantity NOT BETWEEN 1 AND 100 THEN 'quantity out of range' END AS error, count(*) AS lines
FROM line LEFT JOIN part p ON p.p_partkey = variant_id LEFT JOIN pr ON pr.product_id = p.p_partkey
LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 13 <> 4) s ON s.s_suppkey = pr.seller_id
GROUP BY 1, 2""",
    "payments_refused": f"""
WITH r AS (SELECT o_orderkey + CASE WHEN o_orderkey % 14 = 3 THEN {FAR} ELSE 0 END AS order_id,
                  o_custkey + CASE WHEN o_orderkey % 9 = 2 THEN 1 ELSE 0 END AS user_id,
                  CASE WHEN o_orderkey % 5 = 1 THEN 'cash' ELSE 'card' END AS method FROM orders),
  j AS (SELECT r.*, o.o_totalprice, o.o_custkey IS NULL OR o.o_custkey <> r.user_id AS foreign_order
        FROM r LEFT JOIN orders o ON o.o_orderkey = r.order_id),
  k AS (SELECT *, NOT foreign_order AND method = 'card' AS ok FROM j)
SELECT order_id, user_id, method, CASE WHEN ok THEN o_totalprice END AS amount, CASE WHEN ok THEN 'completed' END AS status,
       CASE WHEN ok THEN 'txn_' || substr(sha256(CAST(order_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR)), 1, 32) END AS transaction_id,
       CASE WHEN ok THEN 'paid' END AS order_status,
       CASE WHEN foreign_order THEN 'order not found' WHEN method = 'cash' THEN 'invalid method' END AS reject_reason
FROM k""",
    "order_details_refused": """
SELECT o_orderkey AS order_id, o_custkey AS user_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
       count(*) AS items, CAST(sum(CAST(trunc(l_quantity) AS INTEGER)) AS BIGINT) AS units
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 1 GROUP BY 1, 2, 3""",
    "round_robin_sellers": """
WITH s AS (SELECT s_suppkey AS seller_id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier WHERE s_nationkey % 3 <> 1),
  p AS (SELECT p_partkey AS product_id, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part WHERE p_size % 4 <> 2)
SELECT product_id, seller_id FROM p JOIN s ON s.i = p.i % (SELECT count(*) FROM s)""",
    "products_by_substring": f"""WITH {ORACLE_CATALOG_CTES},
  t AS (SELECT product_id AS id, concat_ws(' ', product_name, description) AS text FROM cp),
  q AS (SELECT DISTINCT unnest([p_name[1:1], p_name[2:3], p_name[3:6], upper(p_name[2:7]), p_name[1:3] || 'zq']) AS pattern
        FROM part WHERE p_partkey % 50 = 1)
SELECT pattern, count(*) AS products, min(id) AS first_product FROM q JOIN t ON contains(lower(text), lower(pattern)) GROUP BY pattern""",
    "dashboard_panels": " UNION ALL ".join(
        f"SELECT '{panel}' AS panel, {f'CAST({day} AS DATE)' if day else 'CAST(NULL AS DATE)'} AS day, "
        f"{name or 'CAST(NULL AS VARCHAR)'} AS name, CAST({value} AS DOUBLE) AS value FROM ({REPORT_SQL[report]})"
        for panel, (report, day, name, value) in PANELS.items()),
}
