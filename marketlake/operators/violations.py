"""Integrity kept up to date: a table of violations maintained by changed keys (K1, K2, K3, K5).

Rows are (rule, item_id) for order items against orders and sellers. A batch names the items it changed
(old and new images) and the parents it added or removed. Only what these can touch is checked again:

* the changed items themselves;
* items of a parent that came or went (an orphan may be repaired, or made);
* items that share a natural key with an old or new image (a duplicate may be made, or resolved).

Whatever duplicates such an item shares its order and seller, so the items checked again hold every
group they belong to, and the checks over them alone are exact.

Items are dealt to tasks by their number (:func:`tasks`) before they are grouped or joined:
a task's sorts and hash tables then stay as they are when the tables grow, and a group is not built twice.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored_cut
from . import quality as Q

NATURAL = ["order_id", "product_id", "seller_id"]
TASK_ITEMS = 500_000


def tasks(spark: SparkSession, n_items: int) -> int:
    """How many tasks ``n_items`` are dealt to: those of the session, more if a task would get too many."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_items // TASK_ITEMS))


def check(items: DataFrame, orders: DataFrame, sellers: DataFrame, parts: int | None = None) -> DataFrame:
    """(rule, item_id): every violation. items: item_id, order_id, product_id, seller_id, quantity; ``parts``: see :func:`tasks`."""
    parts = parts or tasks(items.sparkSession, 0)
    same = items.where("order_id IS NOT NULL AND product_id IS NOT NULL AND seller_id IS NOT NULL")
    same = same.select("item_id", *NATURAL).repartition(parts, *NATURAL)
    ordered = items.where("order_id IS NOT NULL").select("item_id", "order_id").repartition(parts, "order_id")
    found = {
        # of a task's keys at most half are double, so they need no sort
        "duplicate_line": same.join(Q.unique_key(same, NATURAL).hint("shuffle_hash"), NATURAL, "left_semi"),
        "orphan_order": Q.foreign_key(ordered, ["order_id"], orders, ["order_id"]),
        "orphan_seller": Q.foreign_key(items, ["seller_id"], sellers, ["seller_id"]),
        "missing_seller": Q.not_null(items, ["seller_id"]),
        "quantity_out_of_range": Q.range_check(items, Q.standard_ranges(quantity="quantity")),
    }
    rows = [broken.select(F.lit(rule).alias("rule"), "item_id") for rule, broken in found.items()]
    return functools.reduce(DataFrame.unionByName, rows)


def touched_items(items: DataFrame, old: DataFrame, new: DataFrame, order_ids: DataFrame, seller_ids: DataFrame,
                  parts: int | None = None) -> DataFrame:
    """(item_id) of all items whose violations a batch can change. ``items``: after the batch."""
    images = old.select("item_id", *NATURAL).unionByName(new.select("item_id", *NATURAL))
    found = [images.select("item_id"),
             items.join(order_ids.distinct(), "order_id", "left_semi").select("item_id"),
             items.join(seller_ids.distinct(), "seller_id", "left_semi").select("item_id"),
             items.join(images.select(*NATURAL).distinct(), NATURAL, "left_semi").select("item_id")]
    found = functools.reduce(DataFrame.unionByName, found)
    return found.repartition(parts or tasks(items.sparkSession, 0), "item_id").distinct()


def maintain(kept: DataFrame, items: DataFrame, orders: DataFrame, sellers: DataFrame, old: DataFrame, new: DataFrame,
             order_ids: DataFrame, seller_ids: DataFrame, parts: int | None = None) -> DataFrame:
    """The violations after a batch, from those before it.

    items, orders, sellers: after the batch; old, new: images of the changed items (old only: deleted, new
    only: added); order_ids, seller_ids: parents added or removed.
    """
    parts = parts or tasks(items.sparkSession, 0)
    # both feed several checks, so they are written once
    touched = stored_cut(touched_items(items, old, new, order_ids, seller_ids, parts)).repartition(parts, "item_id")
    some = stored_cut(items.repartition(parts, "item_id").join(touched, "item_id", "left_semi"))
    of = orders.join(some.select("order_id").distinct(), "order_id", "left_semi")
    by = sellers.join(some.select("seller_id").distinct(), "seller_id", "left_semi")
    kept = kept.repartition(parts, "item_id")
    return kept.join(touched, "item_id", "left_anti").select("rule", "item_id").unionByName(check(some, of, by, parts))
