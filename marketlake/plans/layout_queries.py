"""Registered queries over stored forms: sketches (Q11, Q18), a clustered table (P5-P7), mapped search documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates as D
from ..operators import catalog as CAT
from ..operators import layout as LY
from ..operators import sketches as SK
from ..session import durable_cut, ensure_checkpoint_dir
from ..sources.catalog import ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star


def customers_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11/Q18: distinct customers a month and category, exact, and whether the union of stored daily sketches agrees within 4 errors."""
    star = Star(spark, sf_dir)
    lines = star.order_items().join(star.orders().select("order_id", "order_date", "user_id"), "order_id").join(
        star.products().select("product_id", "main_category"), "product_id").withColumn("day", D.day_trunc("order_date"))
    daily = durable_cut(SK.daily_sketches(lines, "day", "user_id", ["main_category"]).withColumn("month", D.month_trunc("day")))
    guess = SK.distinct_estimate(daily, None, ["month", "main_category"])
    exact = lines.groupBy(D.month_trunc("day").alias("month"), "main_category").agg(F.count_distinct("user_id").alias("customers"))
    off = F.abs(F.col("estimate") - F.col("customers"))
    return exact.join(guess, ["month", "main_category"]).select(
        "month", "main_category", "customers", (off <= 4 * SK.standard_error() * F.col("customers") + 0.5).alias("sketch_agrees"))


# The windows of the clustered table's query.
FROM, TO, SELLERS, PRODUCTS = "1996-03-01", "1996-03-31", (3, 5), (100, 140)


def clustered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter each by date, seller and product over order lines stored along a space-filling curve."""
    star = Star(spark, sf_dir)
    lines = star.order_items().join(star.orders().select("order_id", "order_date"), "order_id")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    LY.write_clustered(lines, path, ["order_date", "seller_id", "product_id"], files=64)
    stored = spark.read.parquet(path)

    def total(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))

    return total("date", D.time_range_filter(stored, "order_date", FROM, TO)).unionByName(
        total("seller", stored.where(F.col("seller_id").between(*SELLERS)))).unionByName(
        total("product", stored.where(F.col("product_id").between(*PRODUCTS))))


def mapped_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents cast to the declared mapping, with their categories as attributes."""
    c = Catalog(Star(spark, sf_dir))
    docs = CAT.search_document(c.products(), c.variants(), c.media(), constants=False)
    more = c.products().select(F.col("product_id").alias("id"), "seller_id", F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("main_category", "sub_category")]).alias("attributes"))
    out = schemas.conform(docs.join(CAT.by_key(more), "id"), schemas.SEARCH_DOCUMENT)
    return out.select("id", "name", "category", F.col("price").cast("double").alias("price"), "seller_id", "stock",
                      F.size("attributes").alias("n_attributes"), F.col("attributes")[1]["value"].alias("second_attribute"))


LAYOUT_QUERIES = {f.__name__: f for f in (customers_by_sketch, clustered_lines, mapped_search_documents)}

_LINES = """line AS (SELECT o_orderdate AS order_date, o_custkey AS user_id, l_partkey AS product_id, l_suppkey AS seller_id,
                          CAST(trunc(l_quantity) AS INTEGER) AS quantity
                   FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

LAYOUT_SQL = {
    "customers_by_sketch": f"""WITH {_LINES}
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, p_type AS main_category,
       count(DISTINCT user_id) AS customers, TRUE AS sketch_agrees
FROM line JOIN part ON p_partkey = product_id GROUP BY 1, 2""",
    "clustered_lines": f"""WITH {_LINES}
SELECT 'date' AS filter, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS units FROM line
WHERE order_date BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'
UNION ALL SELECT 'seller', count(*), CAST(sum(quantity) AS BIGINT) FROM line WHERE seller_id BETWEEN {SELLERS[0]} AND {SELLERS[1]}
UNION ALL SELECT 'product', count(*), CAST(sum(quantity) AS BIGINT) FROM line WHERE product_id BETWEEN {PRODUCTS[0]} AND {PRODUCTS[1]}""",
    "mapped_search_documents": f"""WITH {ORACLE_CATALOG_CTES}
SELECT cp.product_id AS id, cp.product_name AS name, cp.main_category AS category,
       CAST(CAST(coalesce(CAST(v.price AS DOUBLE), 0.0) AS FLOAT) AS DOUBLE) AS price, CAST(cp.seller_id AS INTEGER) AS seller_id,
       CAST(coalesce(v.stock, 0) AS INTEGER) AS stock, 2 AS n_attributes, cp.sub_category AS second_attribute
FROM cp LEFT JOIN (SELECT product_id, arg_min(price, variant_id) AS price, arg_min(stock, variant_id) AS stock
                   FROM cvar GROUP BY 1) v USING (product_id)""",
}
