"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as CAT
from ..sources.catalog import MEDIA_BASE_URL, ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star

# The listing request used by the registered queries.
LISTING_FILTERS = {"status": "active,draft", "search": "bolt", "min_price": 905, "max_price": 990}
LISTING_PAGE, LISTING_LIMIT = 2, 12


def _cat(spark, sf_dir) -> Catalog:
    return Catalog(Star(spark, sf_dir))


def catalog_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Size x Color variant (default variant when no options)."""
    v = _cat(spark, sf_dir).variants()
    return v.select("variant_id", "product_id", "option1", "option2", "option3",
                    F.col("price").cast("double").alias("price"), "stock")


def product_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested product documents, flattened for checking."""
    c = _cat(spark, sf_dir)
    doc = CAT.product_document(c.products(), c.options(), c.items(), c.variants(), c.media())
    return CAT.document_summary(doc)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents (constant rating/category, as the source sync)."""
    c = _cat(spark, sf_dir)
    return CAT.search_document(c.products(), c.variants(), c.media(), constants=True)


def product_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact product rows with main price and image URL."""
    c = _cat(spark, sf_dir)
    return CAT.product_card(c.products(), c.variants(), c.media(), MEDIA_BASE_URL)


def product_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered listing, page 2 of 12."""
    c = _cat(spark, sf_dir)
    f = CAT.filter_products(c.products(), c.variants(), LISTING_FILTERS)
    page = CAT.paginate(f.select("product_id", "product_name", "status"), LISTING_PAGE, LISTING_LIMIT)
    return page


def visible_variant_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active products joined with variants in a price band (fan-out), first 12."""
    c = _cat(spark, sf_dir)
    vis = CAT.visible_products(c.products().select("product_id", "product_name", "status", "seller_id"))
    j = CAT.variant_price_join(vis, c.variants(), min_price=950, max_price=960)
    out = j.select("product_id", "product_name", "variant_id",
                   F.col("variant_price").cast("double").alias("variant_price"))
    return CAT.limit_list(out, 12, order=("product_id", "variant_id"))


def seller_product_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per seller (and id range) the sorted ids of its products."""
    star = Star(spark, sf_dir)
    c = Catalog(star)
    return CAT.seller_product_ids(c.products(), star.sellers())


def option_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item ids per option of each product."""
    c = _cat(spark, sf_dir)
    return CAT.items_by_option(c.options(), c.items())


def cascade_delete_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete archived products; count what remains of each child table."""
    c = _cat(spark, sf_dir)
    deleted = c.products().filter(F.col("status") == "archived")
    opts = c.options()
    kids = CAT.cascade_delete(deleted, {"options": opts, "variants": c.variants(), "media": c.media()})
    items = c.items().join(kids["options"].select("option_id"), "option_id", "left_semi")
    parts = [kids["options"], items, kids["variants"], kids["media"]]
    names = ["product_options", "product_option_items", "product_variants", "product_media"]
    out = None
    for n, df in zip(names, parts):
        row = df.agg(F.count(F.lit(1)).alias("remaining_rows")).select(F.lit(n).alias("table_name"), "remaining_rows")
        out = row if out is None else out.unionByName(row)
    return out


def variants_after_item_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting the 'XL' items nulls option1 of the variants that used them."""
    c = _cat(spark, sf_dir)
    kept_items = c.items().filter(F.col("item_name") != "XL")
    v = CAT.fk_set_null(c.variants(), ["option1", "option2", "option3"], kept_items, "item_id")
    return v.select("variant_id", "product_id", "option1", "option2", "option3")


CATALOG_QUERIES = {
    "catalog_variants": catalog_variants,
    "product_document_summary": product_document_summary,
    "search_documents": search_documents,
    "product_cards": product_cards,
    "product_listing_page": product_listing_page,
    "visible_variant_listing": visible_variant_listing,
    "seller_product_ids": seller_product_ids,
    "option_items": option_items,
    "cascade_delete_archived": cascade_delete_archived,
    "variants_after_item_delete": variants_after_item_delete,
}


def _w(body: str) -> str:
    return f"WITH {ORACLE_CATALOG_CTES}\n{body}"


CATALOG_SQL = {
    "catalog_variants": _w("""
SELECT variant_id, product_id, option1, option2, option3, CAST(price AS DOUBLE) AS price, stock FROM cvar"""),
    "product_document_summary": _w("""
SELECT cp.product_id, cp.product_name, cp.status,
       strftime(cp.created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CAST(coalesce(o.n, 0) AS INTEGER) AS n_options, CAST(coalesce(i.n, 0) AS INTEGER) AS n_items,
       CAST(coalesce(v.n, 0) AS INTEGER) AS n_variants, CAST(coalesce(m.n, 0) AS INTEGER) AS n_media,
       v.first_id AS first_variant_id, m.first_src AS first_media_src
FROM cp
LEFT JOIN (SELECT product_id, count(*) AS n FROM copt GROUP BY 1) o USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS n FROM citem JOIN copt USING (option_id) GROUP BY 1) i USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS n, min(variant_id) AS first_id FROM cvar GROUP BY 1) v USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS n, arg_min(src, media_id) AS first_src FROM cmed GROUP BY 1) m
  USING (product_id)"""),
    "search_documents": _w("""
SELECT cp.product_id AS id, cp.product_name AS name, cp.description, cp.status,
       CASE WHEN microsecond(cp.created_at) % 1000000 = 0 THEN strftime(cp.created_at, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(cp.created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at,
       coalesce(CAST(v.price AS DOUBLE), 0.0) AS price, coalesce(v.stock, 0) AS stock,
       CAST(4.5 AS DOUBLE) AS rating, 'general' AS category, m.src AS image_url
FROM cp
LEFT JOIN (SELECT product_id, arg_min(price, variant_id) AS price, arg_min(stock, variant_id) AS stock
           FROM cvar GROUP BY 1) v USING (product_id)
LEFT JOIN (SELECT product_id, arg_min(src, media_id) AS src FROM cmed GROUP BY 1) m USING (product_id)"""),
    "product_cards": _w(f"""
SELECT cp.product_id AS id, cp.product_name, cp.description, cp.status,
       coalesce(CAST(v.price AS DOUBLE), 0.0) AS price,
       '{MEDIA_BASE_URL}/media/products/' || CAST(cp.product_id AS VARCHAR) || '/' || m.src AS image_url,
       cp.seller_id, strftime(cp.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM cp
LEFT JOIN (SELECT product_id, arg_min(price, variant_id) AS price FROM cvar GROUP BY 1) v USING (product_id)
LEFT JOIN (SELECT product_id, arg_min(src, media_id) AS src FROM cmed GROUP BY 1) m USING (product_id)"""),
    "product_listing_page": _w("""
, f AS (SELECT product_id, product_name, status FROM cp
        WHERE status IN ('active', 'draft')
          AND (product_name ILIKE '%bolt%' OR description ILIKE '%bolt%')
          AND product_id IN (SELECT product_id FROM cvar GROUP BY product_id
                             HAVING min(price) >= 905 AND max(price) <= 990))
SELECT product_id, product_name, status, (SELECT count(*) FROM f) AS total,
       2 AS page, 12 AS "limit", CAST(((SELECT count(*) FROM f) + 12 - 1) // 12 AS BIGINT) AS pages
FROM f ORDER BY product_id LIMIT 12 OFFSET 12""").replace("\n, f AS", ", f AS", 1),
    "visible_variant_listing": _w("""
SELECT cp.product_id, cp.product_name, cvar.variant_id, CAST(cvar.price AS DOUBLE) AS variant_price
FROM cp JOIN cvar ON cvar.product_id = cp.product_id
WHERE cp.status = 'active' AND cvar.price >= 950 AND cvar.price <= 960
ORDER BY cp.product_id, cvar.variant_id LIMIT 12"""),
    "seller_product_ids": _w("""
SELECT s.s_suppkey AS seller_id, a.id_range, a.product_ids
FROM supplier s LEFT JOIN (
  SELECT seller_id, CAST(floor(product_id / 1048576) AS BIGINT) AS id_range,
         list(product_id ORDER BY product_id) AS product_ids
  FROM cp GROUP BY 1, 2) a ON a.seller_id = s.s_suppkey"""),
    "option_items": _w("""
SELECT copt.product_id, citem.option_id, list(citem.item_id ORDER BY citem.item_id) AS item_ids
FROM citem JOIN copt USING (option_id) GROUP BY 1, 2"""),
    "cascade_delete_archived": _w("""
, alive AS (SELECT product_id FROM cp WHERE status <> 'archived')
SELECT 'product_options' AS table_name, count(*) AS remaining_rows FROM copt WHERE product_id IN (SELECT * FROM alive)
UNION ALL
SELECT 'product_option_items', count(*) FROM citem JOIN copt USING (option_id)
 WHERE copt.product_id IN (SELECT * FROM alive)
UNION ALL
SELECT 'product_variants', count(*) FROM cvar WHERE product_id IN (SELECT * FROM alive)
UNION ALL
SELECT 'product_media', count(*) FROM cmed WHERE product_id IN (SELECT * FROM alive)""").replace(
        "\n, alive AS", ", alive AS", 1),
    "variants_after_item_delete": _w("""
SELECT variant_id, product_id,
       CASE WHEN option1 IN (SELECT item_id FROM citem WHERE item_name <> 'XL') THEN option1 END AS option1,
       CASE WHEN option2 IN (SELECT item_id FROM citem WHERE item_name <> 'XL') THEN option2 END AS option2,
       CASE WHEN option3 IN (SELECT item_id FROM citem WHERE item_name <> 'XL') THEN option3 END AS option3
FROM cvar"""),
}
