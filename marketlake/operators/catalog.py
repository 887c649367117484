"""Catalog jobs as set-based DataFrame operators.

U6 expand_variants, U4 cascade_delete, U5 fk_set_null, U7/A12
seller_product_ids, U13/A14 product_document, U14 search_document, U15
product_card, A15 items_by_option, J6/A10 price_range_semi, J7
variant_price_join, P8/P9/P12/P15 listing filters, T4/T5 paginate, T8 array
membership edits, W3 first_child, W5 round_robin_assign.

The reference builds these per request with N+1 queries; here each is one
plan over whole tables: children are pre-aggregated per product *before*
the join to products (no fan-out), and every ``collect_list`` is over a
group whose size the catalog rules bound (<= 3 options per product, a few
items per option) or over an explicit id range (seller arrays).
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as TX
from ..session import durable_cut

MAX_OPTIONS = 3  # fixed value: a product has at most three options


def by_key(df: DataFrame) -> DataFrame:
    """``df``, to be joined by its key with both sides shuffled.

    Spark estimates exploded and collected children by the few bytes of their parents' columns, and would
    broadcast millions of them through the driver into every task.
    """
    return df.hint("merge")


# ------------------------------------------------------------------- U6 ----
def expand_variants(products: DataFrame, options: DataFrame, items: DataFrame) -> DataFrame:
    """One variant per combination of option items, padded with null to 3.

    products: product_id (+ any columns, e.g. price and stock, carried over);
    options:  option_id, product_id (option position = option_id order);
    items:    item_id, option_id (item position = item_id order).
    A product without options gets one default variant (all options null); one
    with more than three is left out here and listed by :func:`option_rejects`.
    Output: product columns, option1..option3 (item ids) and ``combo``, the
    combination's ordinal (0-based, first option varies slowest).
    """
    # items per option (bounded by the catalog rules), options per product (<= 3)
    per_option = items.groupBy("option_id").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    opts = options.join(by_key(per_option), "option_id", "inner").groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("option_id", "ids"))).alias("opts")
    )
    j = products.join(by_key(opts), "product_id", "left").where(F.col("opts").isNull() | (F.size("opts") <= MAX_OPTIONS))
    combo = F.lit(0)
    for i in range(MAX_OPTIONS):
        arr = F.when(F.size("opts") > i, F.col("opts")[i]["ids"])
        j = j.select("*", F.posexplode_outer(arr).alias(f"_pos{i}", f"option{i + 1}"))
        n = F.when(F.size("opts") > i, F.size(F.col("opts")[i]["ids"])).otherwise(1)
        combo = combo * n + F.coalesce(F.col(f"_pos{i}"), F.lit(0))
    j = j.withColumn("combo", combo)
    return j.drop("opts", *[f"_pos{i}" for i in range(MAX_OPTIONS)])


def option_rejects(options: DataFrame) -> DataFrame:
    """Products with more options than the rule allows, which have no variants."""
    n = options.groupBy("product_id").agg(F.countDistinct("option_id").alias("n_options"))
    return n.where(F.col("n_options") > MAX_OPTIONS).withColumn("reason", F.lit("more than three options"))


# --------------------------------------------------------------- U4 / U5 ---
def cascade_delete(deleted: DataFrame, children: dict[str, DataFrame], key: str = "product_id"
                   ) -> dict[str, DataFrame]:
    """U4: remove every child row of the deleted parents (left_anti per table)."""
    gone = deleted.select(key)
    return {name: df.join(by_key(gone), key, "left_anti") for name, df in children.items()}


def fk_set_null(df: DataFrame, fk_cols: Sequence[str], parent: DataFrame, parent_key: str) -> DataFrame:
    """ON DELETE SET NULL - foreign keys whose parent is gone become null.

    Rows without a key are dealt by a hash of the row, so that they do not meet in one task.
    """
    # always 0, but no literal: Spark would drop a literal from the join's keys
    zero = F.pmod(F.xxhash64("_k"), F.lit(1))
    alive = parent.select(F.col(parent_key).alias("_k")).distinct()
    out = df
    for c in fk_cols:
        flag = alive.select(F.col("_k").alias(c), zero.alias("_dealt"), F.lit(True).alias(f"_ok_{c}"))
        dealt = F.when(F.col(c).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0))
        out = out.withColumn("_dealt", dealt).join(by_key(flag), [c, "_dealt"], "left").withColumn(
            c, F.when(F.col(f"_ok_{c}").isNotNull(), F.col(c))
        ).drop(f"_ok_{c}", "_dealt")
    return out.select(*df.columns)


# --------------------------------------------------------------- A12 / U7 --
def seller_product_pairs(products: DataFrame) -> DataFrame:
    """Normalized (seller_id, product_id) pairs: the scalable form of U7."""
    return products.select("seller_id", "product_id").where(F.col("seller_id").isNotNull())


def seller_product_ids(products: DataFrame, sellers: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Per seller, sorted product ids (null when the seller has none).

    Arrays are built per (seller, id range of width ``chunk``) so no single
    array - and no single task - holds an unbounded group, even for a seller
    owning a third of the catalog; a seller with several ranges gets several
    rows. ``id_range`` is part of the result's key at every size; the rows of a
    seller, concatenated in range order, give the full list.
    """
    pairs = seller_product_pairs(products).withColumn("id_range", F.floor(F.col("product_id") / chunk))
    arrays = pairs.groupBy("seller_id", "id_range").agg(
        F.sort_array(F.collect_list("product_id")).alias("product_ids")
    )
    return sellers.select("seller_id").join(arrays, "seller_id", "left")


def append_unique(arr: Column, value: Column) -> Column:
    """Add ``value`` to the array when absent."""
    return F.when(arr.isNull(), F.array(value)).otherwise(F.array_union(arr, F.array(value)))


def remove_value(arr: Column, value: Column) -> Column:
    """Drop ``value`` from the array."""
    return F.array_remove(arr, value)


# --------------------------------------------------------------------- A15 --
def items_by_option(options: DataFrame, items: DataFrame, product_id=None) -> DataFrame:
    """option_id -> sorted item ids, optionally for one product."""
    o = options if product_id is None else options.filter(F.col("product_id") == product_id)
    j = items.join(by_key(o.select("option_id", "product_id")), "option_id", "inner")
    return j.groupBy("product_id", "option_id").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"))


# ---------------------------------------------------------------- W3 / W5 --
def first_child(children: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """The child with the lowest ``order`` per parent (min_by, partial agg)."""
    return children.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_first")
    ).select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])


def round_robin_assign(df: DataFrame, key: str, n: Column | int) -> Column:
    """Slot ``key mod n``: W5 where the keys are dense and begin at zero."""
    return F.pmod(F.col(key), n if isinstance(n, Column) else F.lit(n))


def numbered(df: DataFrame, key: str, out: str = "number", parts: int = 64) -> DataFrame:
    """Adds the place (from 0) of each row in the order of the unique ``key``.

    In two levels: counts per range of keys, then places inside a range, so no task holds all rows. The
    ranges are even shares of the span from the smallest key to the largest.
    """
    k = F.col(key).cast("double")
    ends = df.agg(F.min(k).alias("lo"), F.max(k).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    share = F.coalesce(F.try_divide(k - lo, hi - lo), F.lit(0.0))
    rows = df.withColumn("_part", F.least(F.floor(share * F.lit(parts)), F.lit(parts - 1)))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(upto, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("_in", inside).join(counts, "_part").withColumn(
        out, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_part", "_in", "_before")


def round_robin(items: DataFrame, item_key: str, sellers: DataFrame, seller_key: str) -> DataFrame:
    """The i-th item (by key) goes to seller number i mod n of the seller list (by key), whatever the keys are."""
    listed = numbered(sellers.select(F.col(seller_key).alias("_seller")), "_seller", "_number")
    n = sellers.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = numbered(items, item_key, "_place").withColumn("_slot", F.pmod("_place", F.nullif(n, F.lit(0))))
    return placed.join(listed, F.col("_slot") == F.col("_number"), "left").select(
        *items.columns, F.col("_seller").alias(seller_key))


# --------------------------------------------------------- U13 / A14 / J5 --
def product_document(products: DataFrame, options: DataFrame, items: DataFrame,
                     variants: DataFrame, media: DataFrame) -> DataFrame:
    """Nested product record: options[items[]], variants[], media[].

    Each child list is aggregated per product first, then left-joined (a
    product without children gets null, not an empty list).
    """
    it = items.groupBy("option_id").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "item_name"))).alias("items")
    )
    op = options.join(by_key(it), "option_id", "left").groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("option_id", "option_name", "items"))).alias("options")
    )
    va = variants.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("variant_id", "price", "stock", "option1", "option2", "option3")))
        .alias("variants")
    )
    me = media.groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("media_id", "src", "alt", "type"))).alias("media")
    )
    base = products.select(
        "product_id", "product_name", "description", "status",
        D.format_datetime(F.col("created_at")).alias("created_at"),
        D.format_datetime(F.col("updated_at")).alias("updated_at"),
    )
    for children in (op, va, me):
        base = base.join(by_key(children), "product_id", "left")
    return base


def document_summary(doc: DataFrame) -> DataFrame:
    """Flat view of :func:`product_document` (sizes and first children)."""
    n_items = F.aggregate(
        F.coalesce(F.col("options"), F.array().cast("array<struct<option_id:bigint,option_name:string,items:array<struct<item_id:bigint,item_name:string>>>>")),
        F.lit(0), lambda acc, o: acc + F.coalesce(F.size(o["items"]), F.lit(0)))
    return doc.select(
        "product_id", "product_name", "status", "created_at",
        F.when(F.col("options").isNull(), 0).otherwise(F.size("options")).alias("n_options"),
        n_items.alias("n_items"),
        F.when(F.col("variants").isNull(), 0).otherwise(F.size("variants")).alias("n_variants"),
        F.when(F.col("media").isNull(), 0).otherwise(F.size("media")).alias("n_media"),
        F.col("variants")[0]["variant_id"].alias("first_variant_id"),
        F.col("media")[0]["src"].alias("first_media_src"),
    )


# ------------------------------------------------------------------ U14 ----
def search_document(products: DataFrame, variants: DataFrame, media: DataFrame,
                    constants: bool = True) -> DataFrame:
    """Id, name, description, status, created_at, price/stock of the
    first variant (else 0), rating, category, first image.

    ``constants=True`` reproduces the source sync (rating 4.5, category
    'general'); ``False`` uses the product's own rating and main category.
    """
    fv = first_child(variants, "product_id", "variant_id", ["price", "stock"]).withColumnsRenamed(
        {"price": "_v_price", "stock": "_v_stock"})
    fm = first_child(media, "product_id", "media_id", ["src"])
    j = products.join(by_key(fv), "product_id", "left").join(by_key(fm), "product_id", "left")
    rating = F.lit(4.5) if constants else F.col("external_ratings").cast("double")
    category = F.lit("general") if constants else F.col("main_category")
    return j.select(
        F.col("product_id").alias("id"),
        F.col("product_name").alias("name"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        "status",
        D.iso_format(F.col("created_at")).alias("created_at"),
        F.coalesce(F.col("_v_price").cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(F.col("_v_stock"), F.lit(0)).alias("stock"),
        rating.alias("rating"),
        category.alias("category"),
        F.col("src").alias("image_url"),
    )


# ------------------------------------------------------------------ U15 ----
def product_card(products: DataFrame, variants: DataFrame, media: DataFrame, base_url: str) -> DataFrame:
    """Compact row: main variant price (else 0), main image URL, seller."""
    fv = first_child(variants, "product_id", "variant_id", ["price"]).withColumnRenamed("price", "_v_price")
    fm = first_child(media, "product_id", "media_id", ["src"])
    j = products.join(by_key(fv), "product_id", "left").join(by_key(fm), "product_id", "left")
    return j.select(
        F.col("product_id").alias("id"), "product_name", "description", "status",
        F.coalesce(F.col("_v_price").cast("double"), F.lit(0.0)).alias("price"),
        TX.media_url(base_url, F.col("product_id"), F.col("src")).alias("image_url"),
        "seller_id",
        D.format_datetime(F.col("created_at")).alias("created_at"),
    )


# ------------------------------------------------------- J6 / A10 / J7 -----
def price_range_semi(products: DataFrame, variants: DataFrame, min_price=None, max_price=None) -> DataFrame:
    """Products whose variants all lie in [min, max] (defaults 0, inf).

    ``max_price`` 0 means no upper bound, as in the source.

    No range given -> no filter. With a range, products without variants drop.
    """
    if min_price is None and max_price is None:
        return products
    lo = min_price or 0
    g = variants.groupBy("product_id").agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    g = g.filter(F.col("_lo") >= F.lit(lo))
    if max_price:
        g = g.filter(F.col("_hi") <= F.lit(max_price))
    return products.join(by_key(g.select("product_id")), "product_id", "left_semi")


def variant_price_join(products: DataFrame, variants: DataFrame, min_price=None, max_price=None,
                       dedupe: bool = False) -> DataFrame:
    """Products x variants with price >= min and <= max (one join).

    Fans out to one row per matching variant unless ``dedupe``.
    """
    v = variants
    if min_price is not None:
        v = v.filter(F.col("price") >= F.lit(min_price))
    if max_price is not None:
        v = v.filter(F.col("price") <= F.lit(max_price))
    if dedupe:
        return products.join(by_key(v.select("product_id")), "product_id", "left_semi")
    return products.join(by_key(v.select("product_id", "variant_id", F.col("price").alias("variant_price"))),
                         "product_id", "inner")


# -------------------------------------------------- P8 / P9 / P12 / P15 ----
def status_in(status_csv: str | None) -> Column | None:
    """Comma-separated statuses -> IN."""
    if not status_csv:
        return None
    return F.col("status").isin(*status_csv.split(","))


def text_contains(search: str | None, cols=("product_name", "description")) -> Column | None:
    """Case-insensitive %search% on any of ``cols`` (user wildcards kept)."""
    if not search:
        return None
    pat = f"%{search}%"
    return functools.reduce(lambda a, b: a | b, [F.col(c).ilike(pat) for c in cols])


def conjunctive(*preds: Column | None) -> Column | None:
    """AND of the predicates present (None -> no filter)."""
    present = [p for p in preds if p is not None]
    return functools.reduce(lambda a, b: a & b, present) if present else None


def filter_products(products: DataFrame, variants: DataFrame, filters: dict | None) -> DataFrame:
    """The listing's filter set: status list, price range, text search."""
    filters = filters or {}
    out = products
    pred = conjunctive(status_in(filters.get("status")), text_contains(filters.get("search")))
    if pred is not None:
        out = out.filter(pred)
    return price_range_semi(out, variants, filters.get("min_price"), filters.get("max_price"))


def visible_products(products: DataFrame, status: str | None = None, seller_id=None,
                     visible_status: str = "active") -> DataFrame:
    """Only visible products, plus optional status and seller equality."""
    out = products.filter(F.col("status") == visible_status)
    if status:
        out = out.filter(F.col("status") == status)
    if seller_id:
        out = out.filter(F.col("seller_id") == seller_id)
    return out


# --------------------------------------------------------------- T4 / T5 ---
def numbered_pages(df: DataFrame, limit: int = 12, order: Sequence[str] = ("product_id",)) -> DataFrame:
    """T4 in batch: every row with its ``page_no``, in one pass over the sorted table.

    Rows are dealt by range of the order, so each task numbers its own range; the
    rows ahead of a range are a sum over one count per range. For deep pages, where
    :func:`paginate` would gather page x limit rows.
    """
    ranged = durable_cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    rows = ranged.withColumn("_place", place).join(counts, "_range")
    page = F.floor((F.col("_ahead") + F.col("_place")) / F.lit(limit)) + 1
    return rows.withColumn("page_no", page.cast("bigint")).drop("_range", "_place", "_ahead")


def paginate(df: DataFrame, page: int = 1, limit: int = 12, order: Sequence[str] = ("product_id",),
             max_limit: int = 100) -> DataFrame:
    """T4: one page (stable order) with total, page, limit and pages columns.

    The page is a top-(page*limit) with offset (bounded by the request, never
    the table); ``total`` is a scalar subquery over the same filtered frame.
    """
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be in 1..{max_limit}")
    total = df.select(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.select(
        "*",
        total.alias("total"),
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        TX.page_count(total, F.lit(limit)).alias("pages"),
    )


def limit_list(df: DataFrame, n: int = 12, order: Sequence[str] = ("product_id",)) -> DataFrame:
    """T5: first ``n`` rows in key order."""
    return df.orderBy(*order).limit(n)


# ------------------------------------------------------------------ P11 ----
def edit_permission(requests: DataFrame, users: DataFrame, sellers: DataFrame,
                    products: DataFrame) -> DataFrame:
    """May ``user_id`` edit ``product_id``? (batch of requests)

    admin -> yes; seller -> only products it owns (a join on the normalized
    (seller, product) pairs, not ``array_contains`` over a huge array);
    anyone else -> no. Output: requests + ``allowed``.
    """
    owned = (
        sellers.select("user_id", "seller_id")
        .join(seller_product_pairs(products), "seller_id", "inner")
        .select("user_id", "product_id", F.lit(True).alias("_owns"))
    )
    r = requests.join(users.select("user_id", "role"), "user_id", "left").join(
        owned, ["user_id", "product_id"], "left"
    )
    allowed = (F.col("role") == "admin") | ((F.col("role") == "seller") & F.col("_owns").isNotNull())
    return r.select(*requests.columns, F.coalesce(allowed, F.lit(False)).alias("allowed"))
