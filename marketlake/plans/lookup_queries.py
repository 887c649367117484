"""Registered lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as REG
from ..operators import lookups as L
from ..sources import changes as CH
from ..sources import stream as ST
from ..sources.catalog import ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star


def user_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public user rows with seller profile (seller account = same key)."""
    star = Star(spark, sf_dir)
    sellers = star.sellers().select(F.col("seller_id").alias("user_id"), "seller_id")
    return L.user_record(star.users(activity=True), sellers)


def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level category tree from (type, brand) and each product's ids."""
    c = Catalog(Star(spark, sf_dir))
    p = c.products().select("product_id", "main_category", "sub_category")
    tree = L.category_tree(p.select(F.col("main_category").alias("main"), F.col("sub_category").alias("sub")))
    r = L.resolve_categories(p, tree)
    return r.select("product_id", "main_category_id", "sub_category_id", "parent_name")


def flat_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat product x media x variant list with defaults."""
    c = Catalog(Star(spark, sf_dir))
    return L.flat_catalog(c.products(), c.media(), c.variants())


def customer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: look up every event's user (batch of point lookups) with a found flag."""
    star = Star(spark, sf_dir)
    req = star.raw("events").select("event_id", "user_id")
    return L.point_lookup(req, star.users().select("user_id", "first_name"), "user_id", ["first_name"])


def media_after_pair_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the (product, media) pairs of archived products."""
    c = Catalog(Star(spark, sf_dir))
    media = c.media()
    pairs = media.join(c.products().filter(F.col("status") == "archived").select("product_id"), "product_id",
                       "left_semi").select("product_id", "media_id")
    return L.pair_delete(media, pairs, ["product_id", "media_id"]).select("media_id", "product_id", "src")


def topic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped topics present in the change log and not yet subscribed.

    Existing topics come from the messages derived from the tables; the
    'subscribed' set is the users topic (as after a first subscription).
    """
    star = Star(spark, sf_dir)
    msgs = CH.snapshot_messages(star, "orders").unionByName(CH.event_messages(star.raw("events"))) \
        .unionByName(CH.snapshot_messages(star, "sellers"))
    expected = spark.createDataFrame([(f"postgres.public.{t}",) for t in REG.TABLE_MAPPINGS], "topic string")
    subscribed = spark.createDataFrame([("postgres.public.users",)], "topic string")
    existing = ST.topic_filter(msgs).select("topic").distinct()
    counts = msgs.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))  # no value is read, so none is encoded
    return ST.new_topics(expected, existing, subscribed).join(counts, "topic", "inner")


LOOKUP_QUERIES = {
    "user_records": user_records,
    "category_paths": category_paths,
    "flat_catalog": flat_catalog,
    "customer_lookup": customer_lookup,
    "media_after_pair_delete": media_after_pair_delete,
    "topic_plan": topic_plan,
}

LOOKUP_SQL = {
    "user_records": """
WITH span AS (SELECT o_custkey, min(o_orderdate) AS dj, max(o_orderdate) AS ll FROM orders GROUP BY 1)
SELECT c_custkey AS user_id, concat_ws(' ', c_name, '') AS full_name,
       CAST(18 + c_custkey % 48 AS INTEGER) AS age,
       strftime(span.dj, '%Y-%m-%d %H:%M:%S') AS date_joined,
       strftime(span.ll, '%Y-%m-%d %H:%M:%S') AS last_login,
       s.s_suppkey AS seller_id, s.s_suppkey IS NOT NULL AS is_seller
FROM customer LEFT JOIN span ON span.o_custkey = c_custkey
LEFT JOIN supplier s ON s.s_suppkey = c_custkey""",
    "category_paths": f"""WITH {ORACLE_CATALOG_CTES}
SELECT product_id, main_category AS main_category_id,
       concat_ws('/', main_category, sub_category) AS sub_category_id, main_category AS parent_name
FROM cp""",
    "flat_catalog": f"""WITH {ORACLE_CATALOG_CTES}
SELECT cp.product_id, cp.product_name, cmed.media_id, coalesce(cmed.src, '') AS image, cvar.variant_id,
       coalesce(CAST(cvar.price AS DOUBLE), 0.0) AS price, coalesce(cvar.stock, 0) AS stock
FROM cp LEFT JOIN cmed USING (product_id) LEFT JOIN cvar USING (product_id)""",
    "customer_lookup": """
SELECT e.event_id, e.user_id, c.c_name AS first_name, c.c_custkey IS NOT NULL AS found
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""",
    "media_after_pair_delete": f"""WITH {ORACLE_CATALOG_CTES}
SELECT media_id, product_id, src FROM cmed
WHERE (product_id, media_id) NOT IN (SELECT (cmed.product_id, cmed.media_id) FROM cmed
                                     JOIN cp USING (product_id) WHERE cp.status = 'archived')""",
    "topic_plan": """
SELECT 'postgres.public.' || t AS topic, n AS messages FROM (
  SELECT 'orders' AS t, count(*) AS n FROM orders
  UNION ALL SELECT 'sellers', count(*) FROM supplier)""",
}
