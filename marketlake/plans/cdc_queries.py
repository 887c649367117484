"""Registered CDC / versioning queries over change streams derived from the tables.

Each reads whole driver tables, turns them into change messages, and runs the
same decode -> route -> clean -> version path the streaming job runs per
micro-batch.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc as CDC
from ..operators import versioned as V
from ..sources import changes as CH
from ..sources.testdata import Star

# Fixed value: load time stamped on rows of the registered (reproducible) runs.
ETL_AS_OF = dt.datetime(2001, 8, 2)


def _etl():
    return F.lit(ETL_AS_OF.isoformat(sep=" ")).cast("timestamp")


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _good_rows(msgs: DataFrame, table: str) -> DataFrame:
    good, _bad = CDC.split_rejects(CDC.to_table(CDC.decode(msgs), table, _etl()))
    return good


def cdc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders snapshot stream -> typed orders."""
    star = Star(spark, sf_dir)
    g = _good_rows(CH.snapshot_messages(star, "orders"), "orders")
    return g.select("order_id", "order_date", "user_id", "status")


def cdc_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products snapshot stream -> typed products."""
    star = Star(spark, sf_dir)
    g = _good_rows(CH.snapshot_messages(star, "products"), "products")
    return g.select(
        "product_id", "product_name", "main_category", "sub_category", "external_ratings",
        "external_ratings_count", F.col("external_price").cast("double").alias("external_price"),
    )


def cdc_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order item snapshot stream -> typed order items."""
    star = Star(spark, sf_dir)
    g = _good_rows(CH.snapshot_messages(star, "order_items"), "order_items")
    return g.select("order_id", "product_id", "seller_id", "quantity")


def cdc_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users snapshot stream -> typed users (ISO dates parsed)."""
    star = Star(spark, sf_dir)
    g = _good_rows(CH.snapshot_messages(star, "users"), "users")
    return g.select("user_id", "user_age", "first_name", "last_name", _ntz("date_joined"), _ntz("last_login"))


def cdc_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments snapshot stream -> typed payments."""
    star = Star(spark, sf_dir)
    g = _good_rows(CH.snapshot_messages(star, "payments"), "payments")
    return g.select("payment_id", "order_id", F.col("amount").cast("double").alias("amount"),
                    "currency", "status", _ntz("created_at"))


def cdc_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4/N21 counters: how many event changes load, and how many are deletes."""
    ev = Star(spark, sf_dir).raw("events")
    return CDC.status_counts(CDC.decode(CH.event_messages(ev)))


def cdc_latest_user_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over the users change log built from events (deletes skipped)."""
    ev = Star(spark, sf_dir).raw("events")
    g = _good_rows(CH.event_messages(ev), "users")
    latest = V.latest_version(g, ["user_id"], ["etl_updated_at", "_offset"])
    return latest.select("user_id", _ntz("last_login"), _ntz("date_joined"), "is_active",
                         F.col("_offset").alias("event_id"))


def merge_latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders snapshot + status updates -> latest order per key."""
    star = Star(spark, sf_dir)
    msgs = CH.snapshot_messages(star, "orders").unionByName(CH.order_status_updates(star))
    g = _good_rows(msgs, "orders")
    snap = V.latest_version(g, ["order_id"], ["etl_updated_at", "_offset"])
    return snap.select("order_id", "order_date", "user_id", "status")


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on raw events: newest event per user (ts, then event id)."""
    ev = Star(spark, sf_dir).raw("events").select("user_id", "event_id", "ts", "event_type", "value")
    return V.latest_version(ev, ["user_id"], ["ts", "event_id"])


def patch_users_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users patched with their last event time (only non-null fields change)."""
    star = Star(spark, sf_dir)
    users = star.users(activity=True)
    seen = star.raw("events").groupBy("user_id").agg(F.max("ts").alias("last_login"))
    return V.patch_update(users, seen, ["user_id"])


CDC_QUERIES = {
    "cdc_orders": cdc_orders,
    "cdc_products": cdc_products,
    "cdc_order_items": cdc_order_items,
    "cdc_users": cdc_users,
    "cdc_payments": cdc_payments,
    "cdc_event_status": cdc_event_status,
    "cdc_latest_user_from_events": cdc_latest_user_from_events,
    "merge_latest_orders": merge_latest_orders,
    "latest_event_per_user": latest_event_per_user,
    "patch_users_last_seen": patch_users_last_seen,
}

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'cancelled' END"

CDC_SQL = {
    "cdc_orders": f"""
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS user_id,
       {_STATUS} AS status
FROM orders""",
    "cdc_products": """
SELECT p_partkey AS product_id, p_name AS product_name, p_type AS main_category,
       p_brand AS sub_category, CAST(0.0 AS FLOAT) AS external_ratings,
       CAST(0 AS BIGINT) AS external_ratings_count,
       CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS DOUBLE) AS external_price
FROM part""",
    "cdc_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
       CAST(trunc(l_quantity) AS BIGINT) AS quantity
FROM lineitem""",
    "cdc_users": """
SELECT c_custkey AS user_id, CAST(18 + c_custkey % 48 AS SMALLINT) AS user_age,
       c_name AS first_name, '' AS last_name,
       min(o_orderdate) AS date_joined, max(o_orderdate) AS last_login
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name""",
    "cdc_payments": """
SELECT o_orderkey AS payment_id, o_orderkey AS order_id,
       CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(10,2)) AS DOUBLE) AS amount,
       'USD' AS currency,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
       o_orderdate AS created_at
FROM orders""",
    "cdc_event_status": """
SELECT 'users' AS table_name,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'ok' END AS status,
       count(*) AS messages
FROM events GROUP BY 1, 2""",
    "cdc_latest_user_from_events": """
SELECT user_id, ts AS last_login,
       CASE WHEN event_type = 'signup' THEN ts END AS date_joined,
       true AS is_active, event_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
      FROM events WHERE event_type <> 'error')
WHERE rn = 1""",
    "merge_latest_orders": f"""
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS user_id,
       CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE {_STATUS} END AS status
FROM orders""",
    "latest_event_per_user": """
SELECT user_id, event_id, ts, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events)
WHERE rn = 1""",
    "patch_users_last_seen": """
WITH span AS (SELECT o_custkey, min(o_orderdate) AS date_joined, max(o_orderdate) AS last_login
              FROM orders GROUP BY o_custkey),
     seen AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, CAST(18 + c_custkey % 48 AS INTEGER) AS user_age,
       c_name AS first_name, '' AS last_name, span.date_joined,
       coalesce(seen.ts, span.last_login) AS last_login
FROM customer LEFT JOIN span ON span.o_custkey = c_custkey
              LEFT JOIN seen ON seen.user_id = c_custkey""",
}
