"""Registered order-processing queries.

Order requests are the driver's line items (one request per order key,
one line per item, arrival order = order date, then key and line); the
variant of a line is its part (price = retail price, stock = part size) and
the owning seller comes from the catalog's round-robin assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import orders as ORD
from ..sources.catalog import Catalog
from ..sources.testdata import Star

ORDER_COLS = ("order_ts", "request_id", "line_no", "variant_id", "line_key")
# Payment method requested per order key mod 3 (one invalid).
METHOD_BY_MOD = ("card", "paypal", "bank_transfer")


def _requests(star: Star) -> DataFrame:
    li = star.raw("lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("line_key"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )
    o = star.orders().select(F.col("order_id").alias("request_id"), F.col("order_date").alias("order_ts"), "user_id")
    return li.join(o, "request_id", "inner")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = Star(spark, sf_dir)
    cat = Catalog(star)
    return ORD.validate_orders(_requests(star), star.variants(), cat.products(), star.sellers(),
                               order_cols=ORDER_COLS, cumulative=True)


def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept or reject each order (first failing line's reason)."""
    v = _validated(spark, sf_dir)
    return v.groupBy(F.col("request_id").alias("order_id"), "accepted", "order_error").agg(
        F.count(F.lit(1)).alias("n_lines")
    )


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the accepted orders at captured variant prices."""
    _lines, orders = ORD.price_orders(_validated(spark, sf_dir))
    return orders.select(F.col("request_id").alias("order_id"),
                         F.col("total_amount").cast("double").alias("total_amount"),
                         "n_items", "n_units", "status")


def stock_after_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant stock after the accepted orders."""
    star = Star(spark, sf_dir)
    lines, _ = ORD.price_orders(_validated(spark, sf_dir))
    return ORD.decrement_stock(star.variants(), lines).select("variant_id", "stock")


def apply_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay every order key with its requested method."""
    star = Star(spark, sf_dir)
    _lines, orders = ORD.price_orders(_validated(spark, sf_dir))
    owners = star.orders().select("order_id", "user_id")
    placed = orders.select(F.col("request_id").alias("order_id"), "total_amount").join(owners, "order_id")
    method = F.element_at(F.array(*map(F.lit, METHOD_BY_MOD)), (F.pmod(F.col("order_id"), F.lit(3)) + 1).cast("int"))
    requests = owners.select("order_id", "user_id", method.alias("method"))
    p = ORD.apply_payments(requests, placed)
    return p.select("order_id", "method", F.col("amount").cast("double").alias("amount"), "status",
                    "transaction_id", "order_status", "reject_reason")


def order_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's items as its owner sees them."""
    star = Star(spark, sf_dir)
    orders = star.orders().select("order_id", "user_id", "status")
    items = star.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )
    d = ORD.order_detail(orders.select("order_id", "user_id"), orders, items, star.products(), star.variants())
    return d.withColumn("price", F.col("price").cast("double"))


ORDER_QUERIES = {
    "validate_orders": validate_orders,
    "priced_orders": priced_orders,
    "stock_after_orders": stock_after_orders,
    "apply_payments": apply_payments,
    "order_details": order_details,
}

_BASE = """
  lines AS (SELECT l.l_orderkey AS request_id, l.l_linenumber AS line_no, l.l_partkey AS variant_id,
                   l.l_suppkey AS line_key, CAST(trunc(l.l_quantity) AS INTEGER) AS quantity,
                   o.o_orderdate AS order_ts, o.o_custkey AS user_id
            FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
  v AS (SELECT p_partkey AS variant_id, p_partkey AS product_id, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
               p_size AS stock FROM part),
  pr AS (SELECT p_partkey AS product_id, p_partkey % (SELECT count(*) FROM supplier) AS seller_id FROM part),
  j AS (SELECT lines.*, v.price, v.stock, pr.product_id, pr.seller_id, s.s_suppkey
        FROM lines LEFT JOIN v USING (variant_id) LEFT JOIN pr ON pr.product_id = v.product_id
        LEFT JOIN supplier s ON s.s_suppkey = pr.seller_id),
  e0 AS (SELECT *, CASE WHEN price IS NULL AND stock IS NULL THEN 'variant not found'
                        WHEN product_id IS NULL THEN 'product not found'
                        WHEN s_suppkey IS NULL THEN 'seller not found'
                        WHEN quantity NOT BETWEEN 1 AND 100 THEN 'quantity out of range' END AS static_error
         FROM j),
  so AS (SELECT request_id, count(*) FILTER (WHERE static_error IS NOT NULL) = 0 AS static_ok FROM e0
         GROUP BY request_id),
  why AS (SELECT request_id, arg_min(static_error, (line_no, variant_id, line_key)) FILTER (WHERE static_error IS NOT NULL)
                 AS static_error FROM e0 GROUP BY request_id),
  need AS (SELECT request_id, variant_id, sum(quantity) AS q, min(stock) AS stock, min(order_ts) AS ts
           FROM e0 JOIN so USING (request_id) WHERE so.static_ok GROUP BY 1, 2),
  -- replay in order of arrival; an order that exceeds a whole stock by itself can be left out beforehand
  able AS (SELECT request_id, min(ts) AS ts FROM need GROUP BY 1 HAVING bool_and(q <= stock)),
  slots AS (SELECT variant_id, stock, row_number() OVER (ORDER BY variant_id) AS slot
            FROM (SELECT DISTINCT variant_id, stock FROM need)),
  queue AS (SELECT row_number() OVER (ORDER BY a.ts, request_id) AS i, request_id,
                   list(slot) AS at, map(list(slot), list(CAST(q AS BIGINT))) AS want
            FROM able a JOIN need USING (request_id) JOIN slots USING (variant_id) GROUP BY request_id, a.ts),
  served(i, request_id, given, rest) AS (
    SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), FALSE, (SELECT list(CAST(stock AS BIGINT) ORDER BY slot) FROM slots)
    UNION ALL
    SELECT i, request_id, given,
           CASE WHEN given THEN list_transform(rest, lambda x, k: x - coalesce(want[k], 0)) ELSE rest END
    FROM (SELECT o.i, o.request_id, o.want, s.rest,
                 list_bool_and(list_transform(o.at, lambda k: s.rest[k] >= o.want[k])) AS given
          FROM served s JOIN queue o ON o.i = s.i + 1)),
  ord AS (SELECT why.request_id, why.static_error, coalesce(s.given, FALSE) AS accepted
          FROM why LEFT JOIN served s ON s.request_id = why.request_id),
  e AS (SELECT * FROM e0),
  acc AS (SELECT e.* FROM e JOIN ord USING (request_id) WHERE ord.accepted),
  tot AS (SELECT request_id AS order_id, CAST(sum(quantity * price) AS DECIMAL(12,2)) AS total_amount,
                 count(*) AS n_items, CAST(sum(quantity) AS BIGINT) AS n_units
          FROM acc GROUP BY request_id)
"""

ORDER_SQL = {
    "validate_orders": f"""WITH RECURSIVE {_BASE}
SELECT order_id, accepted, order_error, count(*) AS n_lines FROM (
  SELECT e.request_id AS order_id, ord.accepted,
         CASE WHEN NOT ord.accepted THEN coalesce(ord.static_error, 'insufficient stock') END AS order_error
  FROM e JOIN ord USING (request_id))
GROUP BY order_id, accepted, order_error""",
    "priced_orders": f"""WITH RECURSIVE {_BASE}
SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount, n_items, n_units, 'created' AS status FROM tot""",
    "stock_after_orders": f"""WITH RECURSIVE {_BASE}
SELECT v.variant_id, CAST(v.stock - coalesce(t.q, 0) AS INTEGER) AS stock
FROM v LEFT JOIN (SELECT variant_id, sum(quantity) AS q FROM acc GROUP BY 1) t USING (variant_id)""",
    "apply_payments": f"""WITH RECURSIVE {_BASE},
  pay AS (SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id, tot.total_amount,
                 tot.order_id IS NULL AS missing,
                 tot.order_id IS NOT NULL AND o.o_orderkey % 3 <> 2 AS ok
          FROM orders o LEFT JOIN tot ON tot.order_id = o.o_orderkey)
SELECT order_id, ['card', 'paypal', 'bank_transfer'][order_id % 3 + 1] AS method,
       CASE WHEN ok THEN CAST(total_amount AS DOUBLE) END AS amount,
       CASE WHEN ok THEN 'completed' END AS status,
       CASE WHEN ok THEN 'txn_' || substr(sha256(CAST(order_id AS VARCHAR) || '|' ||
                                                 CAST(user_id AS VARCHAR)), 1, 32) END AS transaction_id,
       CASE WHEN ok THEN 'paid' END AS order_status,
       CASE WHEN missing THEN 'order not found' WHEN order_id % 3 = 2 THEN 'invalid method' END AS reject_reason
FROM pay""",
    "order_details": """
SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS status,
       l.l_partkey AS product_id, p.p_name AS product_name,
       CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS VARCHAR) || ' USD' AS variant_info,
       CAST(trunc(l.l_quantity) AS INTEGER) AS quantity,
       CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price, l.l_suppkey AS seller_id
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
LEFT JOIN part p ON p.p_partkey = l.l_partkey""",
}
