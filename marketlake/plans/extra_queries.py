"""Registered queries for P11 (edit permission) and the CSV number cleaners
(N1-N3, N5, N6) over text derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import catalog as CAT
from ..sources.catalog import ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star

# Fixed value: one admin account per this many customer keys.
ADMIN_EVERY = 500


def edit_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """May each buyer edit each product they bought?

    Roles: a customer whose key is a multiple of 500 is an admin; a customer
    with a seller profile (seller key == customer key) is a seller; others
    are users. Requests are every (customer, product) pair of the line items.
    """
    star = Star(spark, sf_dir)
    users = star.users().select(
        "user_id",
        F.when(F.pmod("user_id", F.lit(ADMIN_EVERY)) == 0, "admin").otherwise("user").alias("_base"))
    seller_users = star.sellers().select(F.col("seller_id").alias("user_id"), "seller_id")
    users = users.join(seller_users.select("user_id", F.lit(True).alias("_is_seller")), "user_id", "left").select(
        "user_id", F.when(F.col("_base") == "admin", "admin").when(F.col("_is_seller"), "seller")
        .otherwise("user").alias("role"))
    req = star.order_items().select("order_id", "product_id").join(
        star.orders().select("order_id", "user_id"), "order_id", "inner").select("user_id", "product_id")
    products = Catalog(star).products().select("product_id", "seller_id")
    out = CAT.edit_permission(req, users, seller_users, products)
    return out.groupBy("allowed").agg(F.count(F.lit(1)).alias("requests"),
                                      F.count_distinct("user_id").alias("users"))


def _dirty_prices(star: Star) -> DataFrame:
    """Price/count text in the CSV sources' shapes, built from integer keys."""
    p = star.raw("part")
    k, s = F.col("p_partkey"), F.col("p_size")

    def s_(c):
        return c.cast("string")

    thousands = F.pmod(k, F.lit(10))
    body = F.concat(s_(thousands), F.lit(","), F.lpad(s_(s * 7), 3, "0"), F.lit("."), F.lpad(s_(F.pmod(k, F.lit(100))), 2, "0"))
    actual = F.when(F.pmod(k, F.lit(13)) == 0, F.lit("N/A")).otherwise(F.concat(F.lit("₹"), body))
    discount = F.when(F.pmod(k, F.lit(17)) == 0, F.lit("")).otherwise(
        F.concat(F.lit("₹"), s_(thousands), F.lit(","), F.lpad(s_(s * 5), 3, "0")))
    ratings_count = F.concat(s_(s), F.lit(","), F.lpad(s_(F.pmod(k, F.lit(1000))), 3, "0"))
    spaced = F.concat(s_(s), F.lit(" "), F.lpad(s_(F.pmod(k, F.lit(1000))), 3, "0"), F.lit(",50"))
    return p.select(k.alias("product_id"), actual.alias("actual_price"), discount.alias("discount_price"),
                    ratings_count.alias("no_of_ratings"), spaced.alias("spaced"))


def csv_price_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1/N2/N3/N5/N6 side by side on the same dirty text, one row per part."""
    d = _dirty_prices(Star(spark, sf_dir))
    rupee_p, rupee_d = C.clean_money_rupee(F.col("actual_price"), F.col("discount_price"))
    return d.select(
        "product_id",
        C.clean_money_digits("actual_price").cast("double").alias("n1_price"),
        C.clean_money_digits_reject("actual_price").alias("n1_reject"),
        rupee_p.alias("n2_price"), rupee_d.alias("n2_discount"),
        C.clean_number_comma_decimal("actual_price").alias("n3_price"),
        C.clean_number_comma_decimal("spaced").alias("n3_spaced"),
        C.count_strip_commas("no_of_ratings").alias("n5_count"),
        C.count_from_float("no_of_ratings").alias("n6_count"),
    )


EXTRA_QUERIES = {
    "edit_permissions": edit_permissions,
    "csv_price_cleaning": csv_price_cleaning,
}

_DIRTY = """
  d AS (SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 13 = 0 THEN 'N/A'
                    ELSE '₹' || CAST(p_partkey % 10 AS VARCHAR) || ',' || lpad(CAST(p_size * 7 AS VARCHAR), 3, '0')
                         || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') END AS actual_price,
               CASE WHEN p_partkey % 17 = 0 THEN ''
                    ELSE '₹' || CAST(p_partkey % 10 AS VARCHAR) || ',' || lpad(CAST(p_size * 5 AS VARCHAR), 3, '0')
               END AS discount_price,
               CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS no_of_ratings,
               CAST(p_size AS VARCHAR) || ' ' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',50' AS spaced
        FROM part),
  c AS (SELECT *,
               TRY_CAST(replace(replace(trim(actual_price), '₹', ''), ',', '') AS DOUBLE) AS rp,
               TRY_CAST(replace(replace(trim(discount_price), '₹', ''), ',', '') AS DOUBLE) AS rd,
               replace(regexp_replace(regexp_replace(actual_price, '[^0-9., ]', '', 'g'), ' ', '', 'g'), ',', '.') AS n3a,
               replace(regexp_replace(regexp_replace(spaced, '[^0-9., ]', '', 'g'), ' ', '', 'g'), ',', '.') AS n3s,
               replace(regexp_replace(regexp_replace(no_of_ratings, '[^0-9., ]', '', 'g'), ' ', '', 'g'), ',', '.')
                 AS n6c
        FROM d)
"""

EXTRA_SQL = {
    "edit_permissions": f"""WITH {ORACLE_CATALOG_CTES},
  roles AS (SELECT c_custkey AS user_id,
                   CASE WHEN c_custkey % 500 = 0 THEN 'admin'
                        WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'seller' ELSE 'user' END AS role
            FROM customer),
  req AS (SELECT o.o_custkey AS user_id, l.l_partkey AS product_id
          FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
  r AS (SELECT req.user_id,
               coalesce(roles.role = 'admin'
                        OR (roles.role = 'seller' AND EXISTS (SELECT 1 FROM cp WHERE cp.product_id = req.product_id
                                                                AND cp.seller_id = req.user_id)), false) AS allowed
        FROM req LEFT JOIN roles USING (user_id))
SELECT allowed, count(*) AS requests, count(DISTINCT user_id) AS users FROM r GROUP BY allowed""",
    "csv_price_cleaning": f"""WITH {_DIRTY}
SELECT product_id,
       CAST(CASE WHEN actual_price IS NULL OR actual_price = '' THEN CAST(0 AS DECIMAL(10,2))
                 ELSE TRY_CAST(regexp_replace(actual_price, '[^0-9.]', '', 'g') AS DECIMAL(10,2)) END AS DOUBLE)
         AS n1_price,
       (actual_price IS NOT NULL AND actual_price <> ''
        AND TRY_CAST(regexp_replace(actual_price, '[^0-9.]', '', 'g') AS DECIMAL(10,2)) IS NULL) AS n1_reject,
       CASE WHEN rp IS NULL OR rd IS NULL OR isnan(rp) OR isnan(rd) THEN 0.0 ELSE rp END AS n2_price,
       CASE WHEN rp IS NULL OR rd IS NULL OR isnan(rp) OR isnan(rd) THEN 0.0 ELSE rd END AS n2_discount,
       CASE WHEN n3a <> '' THEN TRY_CAST(n3a AS DOUBLE) END AS n3_price,
       CASE WHEN n3s <> '' THEN TRY_CAST(n3s AS DOUBLE) END AS n3_spaced,
       TRY_CAST(replace(no_of_ratings, ',', '') AS INTEGER) AS n5_count,
       CAST(trunc(coalesce(CASE WHEN n6c <> '' THEN TRY_CAST(n6c AS DOUBLE) END, 0.0)) AS INTEGER) AS n6_count
FROM c""",
}
