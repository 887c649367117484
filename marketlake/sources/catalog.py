"""Catalog tables derived from the driver's ``part`` and ``supplier`` tables.

The catalog model (products, options, option items, variants, media) is
filled the way the source seeder fills it from product CSVs, with ``part``
in place of the CSV rows:

* product per part; description ``Description for {name}`` (N20);
  raw status by size band, normalized by N19 (``published`` -> ``draft``);
  seller = part key mod number of sellers (W5 round robin, dense seller ids);
* options Size and Color with fixed items (the seeder's lists), except for
  parts whose size is a multiple of 7 (no options -> one default variant);
* variants = every Size x Color combination (U6) at the base price with
  stock = (size item id + color item id) x 10 (the seeder's rule);
* one image per product except sizes that are multiples of 10 (no media).

All derived with projections, ``explode`` over fixed lists and equi-joins on the
product and option keys, so the catalog scales with ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import catalog as CAT

# The seeder's option lists, in order.
SIZE_ITEMS = ["S", "M", "L", "XL"]
COLOR_ITEMS = ["Red", "Blue", "Black", "White"]
OPTIONS = [("Size", SIZE_ITEMS), ("Color", COLOR_ITEMS)]
# Raw status by part size band, before normalization.
STATUS_BANDS = [(40, "active"), (45, "published")]
STATUS_ELSE = "archived"
CREATED_BASE = "2024-01-01 00:00:00"
MEDIA_BASE_URL = "https://shop.local"


class Catalog:
    def __init__(self, star):
        self.star = star

    def part(self) -> DataFrame:
        """``part`` dealt by key: its file is a task or two, and each row makes up to 16 children."""
        p = self.star.raw("part")
        return p.repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "p_partkey")

    def products(self) -> DataFrame:
        p = self.part()
        n_sellers = self.star.raw("supplier").select(F.count(F.lit(1))).scalar()
        raw_status = F.when(F.col("p_size") <= STATUS_BANDS[0][0], STATUS_BANDS[0][1])
        for bound, name in STATUS_BANDS[1:]:
            raw_status = raw_status.when(F.col("p_size") <= bound, name)
        raw_status = raw_status.otherwise(STATUS_ELSE)
        created = F.timestamp_add("MINUTE", F.col("p_partkey"), F.lit(CREATED_BASE).cast("timestamp_ntz"))
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            C.description_default(F.lit(None).cast("string"), F.col("p_name")).alias("description"),
            C.status_default(raw_status).alias("status"),
            F.col("p_type").alias("main_category"),
            F.col("p_brand").alias("sub_category"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
            (F.col("p_size") / F.lit(10.0)).alias("external_ratings"),
            CAT.round_robin_assign(p, "p_partkey", n_sellers).alias("seller_id"),
            created.alias("created_at"),
            created.alias("updated_at"),
            F.col("p_size").alias("size"),
        )

    def options(self) -> DataFrame:
        p = self.part().filter(F.pmod(F.col("p_size"), F.lit(7)) != 0)
        opts = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("option_name"))
                         for i, (n, _) in enumerate(OPTIONS)])
        e = p.select(F.col("p_partkey").alias("product_id"), F.explode(opts).alias("o"))
        return e.select(
            (F.col("product_id") * len(OPTIONS) + F.col("o.pos")).alias("option_id"),
            "product_id", F.col("o.option_name").alias("option_name"),
        )

    def items(self) -> DataFrame:
        o = self.options()
        per = max(len(items) for _, items in OPTIONS)
        lists = F.create_map(*[x for n, items in OPTIONS for x in (F.lit(n), F.array(*map(F.lit, items)))])
        e = o.select("option_id", F.posexplode(lists[F.col("option_name")]).alias("pos", "item_name"))
        return e.select((F.col("option_id") * per + F.col("pos")).alias("item_id"), "option_id", "item_name")

    def variants(self) -> DataFrame:
        p = self.products().select("product_id", "price")
        v = CAT.expand_variants(p, self.options(), self.items())
        n_combos = 1
        for _, items in OPTIONS:
            n_combos *= len(items)
        stock = F.coalesce((F.col("option1") + F.col("option2")) * 10, F.lit(0)).cast("bigint")
        return v.select(
            (F.col("product_id") * n_combos + F.col("combo")).alias("variant_id"),
            "product_id", "price", stock.alias("stock"), "option1", "option2", "option3",
        )

    def media(self) -> DataFrame:
        p = self.part().filter(F.pmod(F.col("p_size"), F.lit(10)) != 0)
        return p.select(
            F.col("p_partkey").alias("media_id"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("alt"),
            F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("src"),
            F.lit("image").alias("type"),
        )


# DuckDB text of the same catalog, for the oracle SQL.
ORACLE_CATALOG_CTES = """
  cp AS (SELECT p_partkey AS product_id, p_name AS product_name,
                'Description for ' || p_name AS description,
                CASE WHEN p_size <= 40 THEN 'active' WHEN p_size <= 45 THEN 'draft'
                     ELSE 'archived' END AS status,
                p_type AS main_category, p_brand AS sub_category,
                CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size / 10.0 AS external_ratings,
                p_partkey % (SELECT count(*) FROM supplier) AS seller_id,
                TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey) AS created_at,
                p_size AS size
         FROM part),
  copt AS (SELECT p_partkey * 2 + o.pos AS option_id, p_partkey AS product_id, o.option_name
           FROM part, (VALUES (0, 'Size'), (1, 'Color')) o(pos, option_name)
           WHERE p_size % 7 <> 0),
  citem AS (SELECT copt.option_id * 4 + i.pos AS item_id, copt.option_id, i.item_name
            FROM copt JOIN (VALUES ('Size', 0, 'S'), ('Size', 1, 'M'), ('Size', 2, 'L'), ('Size', 3, 'XL'),
                                   ('Color', 0, 'Red'), ('Color', 1, 'Blue'), ('Color', 2, 'Black'),
                                   ('Color', 3, 'White')) i(option_name, pos, item_name)
                 ON i.option_name = copt.option_name),
  cvar AS (SELECT cp.product_id * 16 + s.pos * 4 + c.pos AS variant_id, cp.product_id, cp.price,
                  CAST((s.item_id + c.item_id) * 10 AS BIGINT) AS stock,
                  s.item_id AS option1, c.item_id AS option2, CAST(NULL AS BIGINT) AS option3
           FROM cp
           JOIN (SELECT citem.*, copt.product_id, citem.item_id % 4 AS pos FROM citem JOIN copt USING (option_id)
                 WHERE copt.option_name = 'Size') s ON s.product_id = cp.product_id
           JOIN (SELECT citem.*, copt.product_id, citem.item_id % 4 AS pos FROM citem JOIN copt USING (option_id)
                 WHERE copt.option_name = 'Color') c ON c.product_id = cp.product_id
           UNION ALL
           SELECT product_id * 16, product_id, price, 0, NULL, NULL, NULL FROM cp WHERE size % 7 = 0),
  cmed AS (SELECT p_partkey AS media_id, p_partkey AS product_id, p_name AS alt,
                  'part_' || CAST(p_partkey AS VARCHAR) || '.jpg' AS src, 'image' AS type
           FROM part WHERE p_size % 10 <> 0)
"""
