"""Order jobs as set-based operators: U8-U12, J8, J10, J15, W4, A13, N17, N24.

The source validates and writes one order per request, line by line. Here a
whole batch of order requests is processed at once:

    lookup_lines      J8  line -> variant -> product -> seller, first failing reason
    running_demand    W4  cumulative quantity per variant in arrival order
    allocate          W4  who gets stock, decided in rounds over whole batches
    validate_orders   U9  per-line checks, one bad line rejects its whole order
    price_orders      U8  captured price per line + order totals (A13, N17)
    decrement_stock   U10 stock minus accepted quantity
    apply_payments    U11 payment = order total, method check, txn id (J15, N24)
    order_detail      U12 owner-restricted order with its item rows (J10, N18)

Order-level flags use a grouped aggregate joined back (not a window over the
order), and running sums are two-level prefix sums (per variant and bucket of
arrivals, then within the bucket), so a variant holding a third of all lines
is still split over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..session import durable_cut, stored_cut
from ..functions import text as TX
from .catalog import by_key

# Request bounds and vocabularies of the order API.
MIN_QTY, MAX_QTY = 1, 100
PAYMENT_METHODS = ("card", "paypal")
NEW_ORDER_STATUS = "created"
PAID_STATUS = "paid"
PAYMENT_DONE = "completed"


def lookup_lines(lines: DataFrame, variants: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Attach variant price/stock, product and seller; ``lookup_error``.

    lines: request_id, line_no, variant_id, quantity (+ anything else).
    """
    v = variants.select("variant_id", F.col("product_id").alias("_v_product"), "price", "stock")
    p = products.select(F.col("product_id").alias("_v_product"), "seller_id", F.lit(True).alias("_p_ok"))
    s = sellers.select("seller_id", F.lit(True).alias("_s_ok"))
    j = lines.join(v, "variant_id", "left").join(p, "_v_product", "left").join(s, "seller_id", "left")
    err = (
        F.when(F.col("price").isNull() & F.col("stock").isNull(), "variant not found")
        .when(F.col("_p_ok").isNull(), "product not found")
        .when(F.col("_s_ok").isNull(), "seller not found")
    )
    return j.withColumn("product_id", F.col("_v_product")).withColumn("lookup_error", err).drop(
        "_v_product", "_p_ok", "_s_ok"
    )


def running_demand(lines: DataFrame, key: str, order: Sequence[str], qty: str, bucket: Column) -> Column | DataFrame:
    """Cumulative ``qty`` per ``key`` in ``order`` (inclusive), as a column
    ``demand`` added to ``lines``.

    Two-level prefix sum: totals per (key, bucket) -> prefix over earlier
    buckets of the key (a window over one row per bucket) -> running sum
    inside (key, bucket). ``bucket`` must be monotone in ``order`` (e.g. the
    order day when the order starts with the order time).
    """
    b = lines.withColumn("_bucket", bucket)
    per_bucket = b.groupBy(key, "_bucket").agg(F.sum(qty).alias("_bq"))
    w_b = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(key, "_bucket", F.coalesce(F.sum("_bq").over(w_b), F.lit(0)).alias("_before"))
    w_in = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.withColumn("_run", F.sum(qty).over(w_in))
    return inner.join(offsets, [key, "_bucket"], "inner").withColumn(
        "demand", F.col("_before") + F.col("_run")
    ).drop("_bucket", "_before", "_run")


def _ahead(rows: DataFrame, bucket_bits: int) -> DataFrame:
    """Adds ``_ahead``: the units of the variant that undecided earlier orders ask for.

    Built in two levels, per variant and bucket (arrival time and a run of 2**bucket_bits request
    ids), then inside the bucket, so a variant that holds a third of all rows, even of one day, is many tasks.
    """
    b = rows.withColumn("_bucket", F.struct(F.col("ts"), F.shiftright("request_id", bucket_bits).alias("part")))
    earlier = Window.partitionBy("variant_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("variant_id", "_bucket").agg(F.sum("qty").alias("_sum"))
    sums = sums.select("variant_id", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("variant_id", "_bucket").orderBy("request_id").rowsBetween(
        Window.unboundedPreceding, -1)
    b = b.withColumn("_run", F.coalesce(F.sum("qty").over(inside), F.lit(0)))
    return b.join(sums, ["variant_id", "_bucket"]).withColumn("_ahead", F.col("_before") + F.col("_run")).drop(
        "_bucket", "_before", "_run")


def _without_refused(state: DataFrame) -> DataFrame:
    """The rows of undecided orders, without orders that ask for more of a variant than its stock: they get none."""
    over = state.where(F.col("qty") > F.col("stock")).select("request_id").distinct()
    return durable_cut(state.join(over, "request_id", "left_anti"))


def allocate(demand: DataFrame, bucket_bits: int = 12) -> DataFrame:
    """Orders (``request_id``) that get stock when they are served in order of arrival.

    demand: request_id, variant_id, qty, stock, ts; one row per order and variant,
    served by (ts, request_id). An order takes stock only if all its rows fit, and a
    refused order takes none. Decided in rounds over what is still contested:

    * an order is refused once one of its rows exceeds the stock that the accepted ones left; refused
      orders leave before anything is summed, which in the first round is most of them;
    * a variant whose whole undecided demand fits its stock is contested no more, and its rows leave;
    * an order is accepted once its rows fit even if every earlier undecided order is accepted;
    * decided orders leave, and what the accepted ones take is subtracted from the stock.

    An order accepted before an earlier, undecided one left enough for it, so subtracting at once is
    the same as serving in order. The earliest undecided order is always decided, so the rounds end; they
    are as many as the longest chain of decisions that hang on each other, over ever fewer rows.
    """
    state = _without_refused(demand.select("request_id", "variant_id", "qty", "stock", "ts"))
    accepted = None
    while True:
        total = state.groupBy("variant_id").agg(F.sum("qty").alias("_all"))
        rows = state.join(total, "variant_id").withColumn("_open", F.col("_all") > F.col("stock")).drop("_all")
        contested = _ahead(rows.where("_open"), bucket_bits).select(
            "request_id", (F.col("qty") + F.col("_ahead") <= F.col("stock")).alias("_fits"))
        free = rows.where(~F.col("_open")).select("request_id", F.lit(True).alias("_fits"))
        orders = durable_cut(contested.unionByName(free).groupBy("request_id").agg(F.bool_and("_fits").alias("_accept")))
        given = orders.where("_accept").select("request_id")
        accepted = given if accepted is None else accepted.unionByName(given)
        undecided = orders.where("NOT _accept").select("request_id")
        taken = rows.where("_open").join(given, "request_id", "left_semi").groupBy("variant_id").agg(
            F.sum("qty").alias("_taken"))
        left = rows.where("_open").join(undecided, "request_id", "left_semi").join(taken, "variant_id", "left")
        state = _without_refused(left.select("request_id", "variant_id", "qty",
                                             (F.col("stock") - F.coalesce("_taken", F.lit(0))).alias("stock"), "ts"))
        if state.isEmpty():
            return accepted


def validate_orders(lines: DataFrame, variants: DataFrame, products: DataFrame, sellers: DataFrame,
                    order_cols: Sequence[str] = ("order_ts", "request_id", "line_no"),
                    cumulative: bool = True) -> DataFrame:
    """Per line ``line_error`` and per order ``accepted`` / ``order_error``.

    Checks: lookup (J8), quantity in 1..100, stock. One bad line rejects its order,
    and the first line that fails lookup or quantity names the reason, else stock does.
    ``cumulative=True`` serves orders in order of arrival (W4, :func:`allocate`): a
    line lacks stock when the order's quantity of its variant exceeds what the
    accepted earlier orders left. ``False`` reproduces the per-line check (defect B13).

    The looked-up lines feed several branches, so they are written once to the
    session's checkpoint folder, as Parquet, since each branch reads a few columns.
    """
    j = lookup_lines(lines, variants, products, sellers)
    static = (
        F.when(F.col("lookup_error").isNotNull(), F.col("lookup_error"))
        .when(~F.col("quantity").between(MIN_QTY, MAX_QTY), F.lit("quantity out of range"))
    )
    j = stored_cut(j.withColumn("_static", static))
    first_static = F.min_by("_static", F.when(F.col("_static").isNotNull(), F.struct(*order_cols[1:])))
    if not cumulative:
        short = F.col("_static").isNull() & (F.col("stock") < F.col("quantity"))
        j = j.withColumn("_short", short)
        per_order = j.groupBy("request_id").agg(first_static.alias("_why"), F.bool_or("_short").alias("_no_stock"))
    else:
        # only lines that fail are sorted for their order's first reason
        failing = j.where(F.col("_static").isNotNull()).groupBy("request_id").agg(first_static.alias("_why"))
        checked = j.select("request_id").distinct().join(failing, "request_id", "left")
        demand = j.join(failing.select("request_id"), "request_id", "left_anti").groupBy("request_id", "variant_id").agg(
            F.sum("quantity").alias("qty"), F.first("stock").alias("stock"), F.min(order_cols[0]).alias("ts"))
        demand = stored_cut(demand)
        served = allocate(demand).withColumn("_ok", F.lit(True))
        # a row that exceeds the whole stock is short whatever others took, and its order took nothing
        beyond = F.col("qty") > F.col("stock")
        taken = demand.where(~beyond).join(served, "request_id", "left").withColumn(
            "_taken", F.when(F.col("_ok"), F.col("qty")).otherwise(F.lit(0)))
        taken = running_demand(taken, "variant_id", ["ts", "request_id"], "_taken",
                               F.struct(F.col("ts"), F.shiftright("request_id", 12).alias("part")))
        # the running sum holds the order's own share when it was accepted
        short = F.col("demand") - F.col("_taken") + F.col("qty") > F.col("stock")
        short = taken.select("request_id", "variant_id", short.alias("_short")).unionByName(
            demand.where(beyond).select("request_id", "variant_id", F.lit(True).alias("_short")))
        per_order = checked.join(served, "request_id", "left").select(
            "request_id", "_why", F.col("_ok").isNull().alias("_no_stock"))
        j = j.join(by_key(short), ["request_id", "variant_id"], "left")
    j = j.withColumn("line_error", F.coalesce(F.col("_static"), F.when(
        F.col("_short"), F.lit("insufficient stock")))).drop("_static", "_short")
    bad = F.col("_why").isNotNull() | F.col("_no_stock")
    per_order = per_order.select("request_id", (~bad).alias("accepted"), F.when(
        bad, F.coalesce(F.col("_why"), F.lit("insufficient stock"))).alias("order_error"))
    return j.join(per_order, "request_id", "inner")


def price_orders(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Priced lines of accepted orders and order totals."""
    ok = validated.filter(F.col("accepted"))
    lines = ok.select(
        "request_id", "line_no", "variant_id", "product_id", "seller_id", "quantity",
        F.col("price").cast("decimal(10,2)").alias("price"),
        (F.col("quantity") * F.col("price")).alias("line_total"),
    )
    orders = lines.groupBy("request_id").agg(
        F.sum("line_total").cast("decimal(12,2)").alias("total_amount"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("quantity").cast("bigint").alias("n_units"),
    ).withColumn("status", F.lit(NEW_ORDER_STATUS))
    return lines, orders


def decrement_stock(variants: DataFrame, priced_lines: DataFrame) -> DataFrame:
    """Stock minus the accepted quantity per variant."""
    taken = priced_lines.groupBy("variant_id").agg(F.sum("quantity").alias("_taken"))
    return variants.join(taken, "variant_id", "left").withColumn(
        "stock", (F.col("stock") - F.coalesce(F.col("_taken"), F.lit(0))).cast("int")
    ).drop("_taken")


def apply_payments(requests: DataFrame, orders: DataFrame) -> DataFrame:
    """One payment per request.

    requests: order_id, user_id, method; orders: order_id, user_id, total_amount.
    Unknown order, another user's order, or a method outside card/paypal is
    rejected. Otherwise amount = order total, status completed, a
    deterministic transaction id, and the order becomes ``paid``.
    """
    o = orders.select("order_id", F.col("user_id").alias("_owner"), "total_amount")
    j = requests.join(o, "order_id", "left")
    err = (
        F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "order not found")
        .when(~F.col("method").isin(*PAYMENT_METHODS), "invalid method")
    )
    ok = err.isNull()
    return j.select(
        "order_id", "user_id", "method",
        F.when(ok, F.col("total_amount")).alias("amount"),
        F.when(ok, F.lit(PAYMENT_DONE)).alias("status"),
        F.when(ok, C.transaction_id(F.col("order_id"), F.col("user_id"))).alias("transaction_id"),
        F.when(ok, F.lit(PAID_STATUS)).alias("order_status"),
        err.alias("reject_reason"),
    )


def order_detail(requests: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
                 variants: DataFrame) -> DataFrame:
    """Requested orders (owner only) with one row per item.

    Products/variants missing since the order was placed give nulls (left joins).
    """
    own = requests.join(orders, ["order_id", "user_id"], "inner")
    it = own.join(items, "order_id", "inner")
    it = it.join(products.select("product_id", "product_name"), "product_id", "left")
    it = it.join(variants.select("variant_id", F.col("price").alias("_vprice")), "variant_id", "left")
    return it.select(
        "order_id", "user_id", "status", "product_id", "product_name",
        TX.variant_label(F.col("_vprice")).alias("variant_info"),
        "quantity", "price", "seller_id",
    )
