"""Integrity rules as DataFrame checks (K1-K7); output = violations.

Every check is a grouped aggregate, an anti-join or a filter over whole
tables - the set-based form of the source schema's constraints and request
validators - so it runs as one distributed job per rule.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import by_key

# Value domains of the source schema and services.
DOMAINS = {
    "user_role": ("user", "seller", "admin"),
    "order_status": ("created", "pending", "paid", "completed", "cancelled"),
    "payment_status": ("pending", "completed", "failed"),
    "payment_method": ("card", "paypal"),
    "product_status": ("active", "archived", "draft"),
    "activity_action": ("view", "click", "purchase", "signup", "error"),
}
# Numeric and length bounds of the request validators.
QTY_RANGE = (1, 100)
NAME_LEN = (1, 255)
RATING_RANGE = (0, 5)
MAX_OPTIONS = 3


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K1: key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def foreign_key(child: DataFrame, fk: Sequence[str], parent: DataFrame, pk: Sequence[str]) -> DataFrame:
    """K2: child rows whose (non-null) foreign key has no parent row."""
    cond = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk])
    p = parent.select(*[F.col(k).alias(c) for k, c in zip(pk, fk)]).distinct()
    return child.filter(cond).join(p, list(fk), "left_anti")


def not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K3: rows with a null in a mandatory column, with the null columns listed."""
    nulls = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return df.withColumn("null_columns", nulls).filter(F.size("null_columns") > 0)


def domain_check(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """K4: rows whose value is outside the domain (nulls are K3's business)."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))


def range_rules(rules: dict[str, Column]) -> Column:
    """K5: array of the names of the rules a row breaks (``rule`` = bad-row predicate)."""
    return F.filter(F.array(*[F.when(pred, F.lit(name)) for name, pred in rules.items()]), lambda x: x.isNotNull())


def range_check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """K5: rows breaking any rule, with the broken rule names."""
    return df.withColumn("broken", range_rules(rules)).filter(F.size("broken") > 0)


def standard_ranges(price: str | None = None, stock: str | None = None, quantity: str | None = None,
                    name: str | None = None, rating: str | None = None) -> dict[str, Column]:
    """The source validators' bounds for whichever columns are given."""
    r: dict[str, Column] = {}
    if price:
        r["price_negative"] = F.col(price) < 0
    if stock:
        r["stock_negative"] = F.col(stock) < 0
    if quantity:
        r["quantity_out_of_range"] = ~F.col(quantity).between(*QTY_RANGE)
    if name:
        r["name_length"] = ~F.length(F.col(name)).between(*NAME_LEN)
    if rating:
        r["rating_out_of_range"] = ~F.col(rating).between(*RATING_RANGE)
    return r


def option_rules(options: DataFrame, items: DataFrame) -> DataFrame:
    """K6: (product_id, rule) for products breaking the option rules.

    More than 3 options; an option name used twice; an item name used twice
    across all options of the product; an option without items.
    """
    per_product = options.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_opts"), F.count_distinct("option_name").alias("n_names")
    )
    too_many = per_product.filter(F.col("n_opts") > MAX_OPTIONS).select("product_id", F.lit("too_many_options").alias("rule"))
    dup_opt = per_product.filter(F.col("n_names") < F.col("n_opts")).select(
        "product_id", F.lit("duplicate_option_name").alias("rule"))
    oi = items.join(by_key(options.select("option_id", "product_id")), "option_id", "inner")
    dup_item = oi.groupBy("product_id", "item_name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1) \
        .select("product_id", F.lit("duplicate_item_name").alias("rule")).distinct()
    empty = options.join(by_key(items.select("option_id").distinct()), "option_id", "left_anti").select(
        "product_id", F.lit("option_without_items").alias("rule")).distinct()
    return too_many.unionByName(dup_opt).unionByName(dup_item).unionByName(empty)


def reconcile_totals(orders: DataFrame, lines: DataFrame, payments: DataFrame | None = None,
                     tolerance: float = 0.01) -> DataFrame:
    """K7: orders whose total differs from the sum of its lines (and payments).

    orders: order_id, total_amount; lines: order_id, line_total;
    payments: order_id, amount. Output: order_id + the sums and flags.
    """
    lt = lines.groupBy("order_id").agg(F.sum("line_total").alias("lines_total"), F.count(F.lit(1)).alias("n_lines"))
    j = orders.select("order_id", "total_amount").join(lt, "order_id", "left")
    bad = F.abs(F.col("total_amount") - F.coalesce(F.col("lines_total"), F.lit(0))) > tolerance
    if payments is not None:
        pt = payments.groupBy("order_id").agg(F.sum("amount").alias("paid_total"))
        j = j.join(pt, "order_id", "left")
        bad = bad | (F.abs(F.col("total_amount") - F.coalesce(F.col("paid_total"), F.lit(0))) > tolerance)
    return j.filter(bad)


def count_by_rule(named: dict[str, DataFrame]) -> DataFrame:
    """One row per rule with its number of violations (0 when clean)."""
    out = None
    for rule, df in named.items():
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
