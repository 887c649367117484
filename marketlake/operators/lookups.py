"""Lookups and small relational helpers: P10, P14, J9, J13, J14, U17, T7, A16.

Batch forms of the source's per-request reads: a frame of requests joined
once with the table, instead of one query per request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from .catalog import by_key


def point_lookup(requests: DataFrame, table: DataFrame, key: str, cols: Sequence[str] = ()) -> DataFrame:
    """P10: each request key with ``found`` and the looked-up columns (null if missing)."""
    t = table.select(key, *cols, F.lit(True).alias("_found"))
    j = requests.join(t, key, "left")
    return j.select(*requests.columns, *cols, F.coalesce(F.col("_found"), F.lit(False)).alias("found"))


def pair_delete(df: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop rows matching any (k1, k2, ...) pair (OR of ANDs as an anti-join)."""
    return df.join(pairs.select(*keys).distinct(), list(keys), "left_anti")


def category_tree(names: DataFrame) -> DataFrame:
    """J9 (build): two-level categories from (main, sub) name pairs.

    Output: category_id (the path), name, parent_id (null for top level).
    """
    top = names.select(F.col("main").alias("name")).distinct().select(
        F.col("name").alias("category_id"), "name", F.lit(None).cast("string").alias("parent_id"))
    sub = names.select("main", "sub").distinct().select(
        F.concat_ws("/", "main", "sub").alias("category_id"), F.col("sub").alias("name"),
        F.col("main").alias("parent_id"))
    return top.unionByName(sub)


def resolve_categories(products: DataFrame, tree: DataFrame) -> DataFrame:
    """J9 (resolve): main/sub names -> category ids, and the sub's parent name (self-join)."""
    main = tree.filter(F.col("parent_id").isNull()).select(
        F.col("name").alias("main_category"), F.col("category_id").alias("main_category_id"))
    sub = tree.filter(F.col("parent_id").isNotNull()).alias("c").join(
        tree.alias("p"), F.col("c.parent_id") == F.col("p.category_id"), "inner"
    ).select(F.col("p.name").alias("main_category"), F.col("c.name").alias("sub_category"),
             F.col("c.category_id").alias("sub_category_id"), F.col("p.name").alias("parent_name"))
    return products.join(main, "main_category", "left").join(sub, ["main_category", "sub_category"], "left")


def user_record(users: DataFrame, sellers: DataFrame | None = None) -> DataFrame:
    """U17 + J13: public user projection (no password), formatted dates, seller profile."""
    out = users.select(
        "user_id",
        TX.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        F.col("user_age").alias("age"),
        D.format_datetime(F.col("date_joined")).alias("date_joined"),
        D.format_datetime(F.col("last_login")).alias("last_login"),
    )
    if sellers is None:
        return out
    s = sellers.select("user_id", "seller_id")
    return out.join(s, "user_id", "left").withColumn("is_seller", F.col("seller_id").isNotNull())


def flat_catalog(products: DataFrame, media: DataFrame, variants: DataFrame) -> DataFrame:
    """Product left-join media left-join variant, one flat row per pair."""
    m = media.select("product_id", "media_id", F.col("src").alias("image"))
    v = variants.select("product_id", "variant_id", F.col("price").alias("variant_price"), "stock")
    j = products.select("product_id", "product_name").join(by_key(m), "product_id", "left").join(
        by_key(v), "product_id", "left")
    return j.select(
        "product_id", "product_name", "media_id", F.coalesce("image", F.lit("")).alias("image"),
        "variant_id", F.coalesce(F.col("variant_price").cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce("stock", F.lit(0)).alias("stock"),
    )


def is_empty(df: DataFrame) -> bool:
    """Emptiness test without counting the whole table."""
    return df.limit(1).isEmpty()
