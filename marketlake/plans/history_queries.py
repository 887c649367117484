"""Registered queries over histories: offset ranges (S11, R2) and prices valid in time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import asof as A
from ..operators import ledger as L
from ..operators import versioned as V
from ..session import ensure_checkpoint_dir
from ..sources import changes as CH
from ..sources.buckets import BucketedTable
from ..sources.testdata import Star
from .cdc_queries import CDC_SQL

# Fixed rules: messages of these event ids (mod 97) were lost on the way, or not yet processed.
NOT_PROCESSED = (3, 4, 50)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CH.event_messages(Star(spark, sf_dir).raw("events")).select("topic", "partition", "offset")


def _processed(messages: DataFrame) -> DataFrame:
    return messages.where(~F.pmod("offset", F.lit(97)).isin(*NOT_PROCESSED))


def ledger_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed user messages as disjoint offset ranges, from two batches that overlap out of order."""
    done = _processed(_messages(spark, sf_dir))
    late = L.intervals(done.where(F.pmod("offset", F.lit(5)) != 0))
    early = L.intervals(done.where(F.pmod("offset", F.lit(5)) < 3))
    return L.merged(late.unionByName(early))


def unprocessed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that no range of the ledger holds (range anti-join)."""
    m = _messages(spark, sf_dir)
    return L.unprocessed(m, L.intervals(_processed(m)))


def price_versions(star: Star) -> DataFrame:
    """(product_id, valid_from, price_cents): what a unit of the product last shipped for, per day of shipment."""
    li = star.raw("lineitem")
    cents = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint")
    return li.groupBy(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("valid_from")).agg(
        F.max(cents).alias("price_cents"))


def price_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price version with the time at which the next one takes over."""
    return A.validity(price_versions(Star(spark, sf_dir)), ["product_id"], "valid_from")


def revenue_at_valid_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue at the price valid when the order was placed (as-of join)."""
    star = Star(spark, sf_dir)
    lines = star.order_items().join(star.orders().select("order_id", "order_date"), "order_id").select(
        "product_id", "order_date", "quantity")
    priced = A.asof_join(lines, price_versions(star), ["product_id"], "order_date", "valid_from", ["price_cents"])
    return priced.groupBy(D.month_trunc("order_date").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("price_cents").alias("priced_lines"),
        F.sum(F.col("quantity") * F.col("price_cents")).alias("revenue_cents"))


def bucketed_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event per user, merged in four batches into a table of key buckets."""
    ev = Star(spark, sf_dir).raw("events").select("user_id", "event_id", "ts", "event_type", "value")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/latest-events-{uuid.uuid4().hex}"
    table = BucketedTable(spark, path, F.col("user_id").cast("string"), 16)
    for n in range(4):
        table.merge(ev.where(F.pmod("event_id", F.lit(4)) == n), lambda stored, new: V.latest_version(
            new if stored is None else stored.unionByName(new), ["user_id"], ["ts", "event_id"]))
    table.vacuum()
    return table.read(ev.schema)


HISTORY_QUERIES = {
    "bucketed_latest_events": bucketed_latest_events,
    "ledger_intervals": ledger_intervals,
    "unprocessed_messages": unprocessed_messages,
    "price_validity": price_validity,
    "revenue_at_valid_price": revenue_at_valid_price,
}

_VERSIONS = """versions AS (
  SELECT l_partkey AS product_id, l_shipdate AS valid_from,
         CAST(max(floor(l_extendedprice * 100 / l_quantity)) AS BIGINT) AS price_cents
  FROM lineitem GROUP BY 1, 2)"""
_MESSAGES = """m AS (SELECT 'postgres.public.users' AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id AS "offset" FROM events)"""

HISTORY_SQL = {
    "bucketed_latest_events": CDC_SQL["latest_event_per_user"],
    "ledger_intervals": f"""WITH {_MESSAGES},
  done AS (SELECT DISTINCT * FROM m WHERE "offset" % 97 NOT IN (3, 4, 50)),
  island AS (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, partition ORDER BY "offset") AS i FROM done)
SELECT topic, partition, min("offset") AS lo, max("offset") AS hi FROM island GROUP BY topic, partition, i""",
    "unprocessed_messages": f"""WITH {_MESSAGES} SELECT * FROM m WHERE "offset" % 97 IN (3, 4, 50)""",
    "price_validity": f"""WITH {_VERSIONS}
SELECT *, lead(valid_from) OVER (PARTITION BY product_id ORDER BY valid_from) AS valid_to FROM versions""",
    "revenue_at_valid_price": f"""WITH {_VERSIONS},
  lines AS (SELECT l_partkey AS product_id, o_orderdate AS order_date, CAST(trunc(l_quantity) AS INTEGER) AS quantity
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS lines, count(price_cents) AS priced_lines,
       CAST(sum(quantity * price_cents) AS BIGINT) AS revenue_cents
FROM lines ASOF LEFT JOIN versions v ON v.product_id = lines.product_id AND lines.order_date >= v.valid_from
GROUP BY 1""",
}
