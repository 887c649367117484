"""Star-schema adapter over the driver's TPC-H-ish parquet tables.

Each method returns a DataFrame in the engine's model (the analytics tables
``orders``, ``order_items``, ``products``, ``sellers``, ``users``,
``payments`` and the catalog's ``product_variants``), built only from
projections and casts so that Catalyst keeps column pruning and predicate
pushdown down to the parquet scan.

``order_date`` keeps the physical type of the source column
(``timestamp_ntz`` at midnight here, ``date`` in the versioned tables);
filters build literals of the column's own type (see
``functions.dates.typed_literal``) so the comparison is never wrapped in a
cast and still reaches the scan as a pushed filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# TPC-H order status letters -> order status vocabulary
ORDER_STATUS = {"F": "completed", "O": "pending", "P": "cancelled"}
# TPC-H order status letters -> payment status vocabulary
PAYMENT_STATUS = {"F": "completed", "O": "pending", "P": "failed"}


def _map_status(col, mapping: dict, default: str):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


class Star:
    """Lazily built model tables over one TESTDATA scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- fact ----------------------------------------------------------------
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_custkey").alias("user_id"),
            _map_status(F.col("o_orderstatus"), ORDER_STATUS, "cancelled").alias("status"),
            F.col("o_totalprice").alias("total_amount"),
        )

    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_linenumber").alias("line_no"),
        )

    # -- dimensions ----------------------------------------------------------
    def products(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("main_category"),
            F.col("p_brand").alias("sub_category"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("external_price"),
        )

    def sellers(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("first_name"),
            F.lit("").alias("last_name"),
        )

    def users(self, activity: bool = False) -> DataFrame:
        """Customers as users; ``activity`` adds date_joined / last_login.

        date_joined and last_login are the first and last order date of the
        customer: one partial+final aggregate of ``orders`` on the customer
        key, then a left join (customers without orders keep nulls).
        """
        c = self.raw("customer")
        users = c.select(
            F.col("c_custkey").alias("user_id"),
            (F.lit(18) + F.pmod(F.col("c_custkey"), F.lit(48))).cast("int").alias("user_age"),
            F.col("c_name").alias("first_name"),
            F.lit("").alias("last_name"),
        )
        if not activity:
            return users
        span = (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("user_id"))
            .agg(
                F.min("o_orderdate").alias("date_joined"),
                F.max("o_orderdate").alias("last_login"),
            )
        )
        return users.join(span, "user_id", "left")

    def payments(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("payment_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").alias("amount"),
            F.lit("USD").alias("currency"),
            _map_status(F.col("o_orderstatus"), PAYMENT_STATUS, "failed").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    def variants(self) -> DataFrame:
        """One variant per part: price = retail price, stock = size."""
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("variant_id"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            F.col("p_size").alias("stock"),
        )


# DuckDB text of the same adapter, used by the oracle SQL strings.
ORACLE_STAR_CTES = """
  o AS (SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                    ELSE 'cancelled' END AS status
        FROM orders),
  oi AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
                CAST(trunc(l_quantity) AS INTEGER) AS quantity, l_linenumber AS line_no
         FROM lineitem),
  p AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS main_category,
               p_brand AS sub_category, CAST(p_retailprice AS DECIMAL(10,2)) AS external_price
        FROM part),
  s AS (SELECT s_suppkey AS seller_id, s_name AS first_name, '' AS last_name FROM supplier),
  u AS (SELECT c_custkey AS user_id, CAST(18 + c_custkey % 48 AS INTEGER) AS user_age FROM customer)
"""
