"""Registered queries for rules that no other query exercises alone.

J12/R2 replay guard, N10 default age, N15 whole seconds, N23 connector NUMERIC,
A16 emptiness, T8 array edits, U3 touched timestamps, T4 pages of a whole listing.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import dates as D
from ..operators import catalog as CAT
from ..operators import cdc as CDC
from ..operators import lookups as L
from ..operators import versioned as V
from ..sources.testdata import Star

SEEN_EVERY = 3  # every third event was processed before
TOUCHED_AT = dt.datetime(2001, 8, 1, 12, 30)


def _offsets(events: DataFrame) -> DataFrame:
    return events.select(F.lit("postgres.public.users").alias("topic"), F.pmod("user_id", F.lit(4)).alias("partition"),
                         F.col("event_id").alias("offset"), "event_type")


def replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events not yet in the ledger, which holds every third one."""
    messages = _offsets(Star(spark, sf_dir).raw("events"))
    ledger = messages.where(F.pmod("offset", F.lit(SEEN_EVERY)) == 0)
    return CDC.unseen(messages, ledger).groupBy("event_type", F.col("partition").cast("int").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("last_offset"))


def default_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose age is missing (every seventh) get the default age."""
    users = Star(spark, sf_dir).users()
    age = F.when(F.pmod("user_id", F.lit(7)) != 0, F.col("user_age"))
    return users.select("user_id", C.default_age(age).cast("int").alias("age"))


def event_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per whole second."""
    events = Star(spark, sf_dir).raw("events")
    return events.groupBy(D.second_precision(F.col("ts")).cast("timestamp_ntz").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def connector_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as the connector sends NUMERIC (base64, two's complement), decoded again.

    Every eleventh total is negative and every thirteenth plain text.
    """
    o = Star(spark, sf_dir).raw("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(10,2)").alias("total"))
    total = F.when(F.pmod("order_id", F.lit(11)) == 0, -F.col("total")).otherwise(F.col("total"))
    o = o.withColumn("total", total)
    hexed = F.lpad(F.hex((F.col("total") * 100).cast("bigint")), 16, "0")
    text = F.when(F.pmod("order_id", F.lit(13)) == 0, F.abs("total").cast("string")).otherwise(F.base64(F.unhex(hexed)))
    return o.select("order_id", C.money_from_connector(text).cast("double").alias("amount"),
                    C.money_from_connector_reject(text).alias("rejected"))


def table_emptiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables have no row (one made empty by a filter nothing passes)."""
    star = Star(spark, sf_dir)
    frames = {"orders": star.orders(), "users": star.users(), "free orders": star.orders().where("total_amount < 0")}
    return spark.createDataFrame([(k, L.is_empty(df)) for k, df in frames.items()], "name string, is_empty boolean")


def array_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's list of two part keys, one appended unless present, one removed."""
    s = Star(spark, sf_dir).raw("supplier").select(F.col("s_suppkey").alias("seller_id"))
    ids = F.array(F.col("seller_id"), F.col("seller_id") + 1)
    edit = F.col("seller_id") + F.pmod("seller_id", F.lit(3))
    return s.select("seller_id", CAT.append_unique(ids, edit).alias("appended"), CAT.remove_value(ids, edit).alias("removed"))


def touched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders are changed and get the clock's time, the others keep theirs."""
    o = Star(spark, sf_dir).raw("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    clock = F.lit(TOUCHED_AT).cast("timestamp_ntz")
    return o.select(F.col("o_orderkey").alias("order_id"), V.touch_updated_at(
        F.col("o_orderstatus") == "O", F.col("at"), clock).alias("updated_at"))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the page every product is on when the listing is sorted by price, then id."""
    p = Star(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    return CAT.numbered_pages(p, limit=12, order=("price", "product_id")).select("product_id", "page_no")


SURVEY_QUERIES = {f.__name__: f for f in (replay_guard, default_ages, event_seconds, connector_amounts, table_emptiness,
                                          array_edits, touched_orders, product_pages)}

SURVEY_SQL = {
    "replay_guard": """
SELECT event_type, CAST(user_id % 4 AS INTEGER) AS part, count(*) AS n, max(event_id) AS last_offset
FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2""",
    "default_ages": """
SELECT c_custkey AS user_id, CAST(CASE WHEN c_custkey % 7 = 0 THEN 21 ELSE 18 + c_custkey % 48 END AS INTEGER) AS age
FROM customer""",
    "event_seconds": "SELECT date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY 1",
    "connector_amounts": """
SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE)
       * CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 THEN -1 ELSE 1 END AS amount, FALSE AS rejected FROM orders""",
    "table_emptiness": """
SELECT 'orders' AS name, NOT EXISTS (SELECT 1 FROM orders) AS is_empty
UNION ALL SELECT 'users', NOT EXISTS (SELECT 1 FROM customer)
UNION ALL SELECT 'free orders', NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)""",
    "array_edits": """
WITH e AS (SELECT s_suppkey AS k, [s_suppkey, s_suppkey + 1] AS ids, s_suppkey + s_suppkey % 3 AS x FROM supplier)
SELECT k AS seller_id, CASE WHEN list_contains(ids, x) THEN ids ELSE list_append(ids, x) END AS appended,
       list_filter(ids, lambda y: y <> x) AS removed FROM e""",
    "touched_orders": """
SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2001-08-01 12:30:00'
                                    ELSE CAST(o_orderdate AS TIMESTAMP) END AS updated_at FROM orders""",
    "product_pages": """
SELECT p_partkey AS product_id, (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) // 12 + 1 AS page_no FROM part""",
}
