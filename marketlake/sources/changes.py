"""Change messages ``(topic, partition, offset, value)`` derived from tables.

The capture connector publishes one JSON envelope per row change on a topic
per table. These functions produce the same message frame from the driver's
tables, so the CDC path (decode, route, clean, version) runs over whole tables:

* ``snapshot_messages`` - an initial snapshot (op ``r``) of a model table;
* ``event_messages``   - ``events`` as changes of ``users``: a signup creates
  the user, other events update ``last_login``, an ``error`` event is a
  delete (ignored by default, as in the source pipeline).

Values are JSON text built with ``to_json`` (JVM side). Times are written as
ISO-8601 text without a zone designator, so the round trip through the
cleaners is exact in any session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOPIC_PREFIX

# Event type -> change operation on the users topic.
EVENT_OPS = {"signup": "c", "purchase": "u", "view": "u", "click": "u", "error": "d"}
ISO_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
# Partitions of the simulated topics (the source connector runs 1 task).
TOPIC_PARTITIONS = 4


def iso_text(c: Column) -> Column:
    return F.date_format(c, ISO_FMT)


def _message(table: str, key: Column, op: Column, after: Column | None, before: Column | None,
             offset: Column) -> list[Column]:
    env = F.struct(
        op.alias("op"),
        (before if before is not None else F.lit(None).cast("map<string,string>")).alias("before"),
        (after if after is not None else F.lit(None).cast("map<string,string>")).alias("after"),
    )
    return [
        F.lit(TOPIC_PREFIX + table).alias("topic"),
        F.pmod(key, F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        F.to_json(env).alias("value"),
    ]


def _as_map(**cols: Column) -> Column:
    parts = []
    for k, v in cols.items():
        parts += [F.lit(k), v.cast("string")]
    return F.create_map(*parts)


def snapshot_messages(star, table: str) -> DataFrame:
    """Initial-snapshot messages (op ``r``) for one model table."""
    r = F.lit("r")
    if table == "orders":
        o = star.orders()
        after = _as_map(id=F.col("order_id"), user_id=F.col("user_id"), status=F.col("status"),
                        created_at=iso_text(F.col("order_date")))
        return o.select(*_message(table, F.col("order_id"), r, after, None, F.col("order_id")))
    if table == "order_items":
        li = star.raw("lineitem").repartition("l_orderkey")  # JSON encoding is CPU-bound
        # Line items have no single-column key (even order/line/part/supplier
        # repeats), so the line id - and the message offset - hash the whole row.
        key = F.xxhash64(*li.columns)
        after = _as_map(id=key, order_id=F.col("l_orderkey"), product_id=F.col("l_partkey"),
                        seller_id=F.col("l_suppkey"), quantity=F.col("l_quantity").cast("int"))
        return li.select(*_message(table, F.col("l_orderkey"), r, after, None, key))
    if table == "products":
        p = star.raw("part")
        after = _as_map(id=F.col("p_partkey"), product_name=F.col("p_name"), main_category=F.col("p_type"),
                        sub_category=F.col("p_brand"), external_price=F.col("p_retailprice"))
        return p.select(*_message(table, F.col("p_partkey"), r, after, None, F.col("p_partkey")))
    if table == "sellers":
        s = star.sellers()
        after = _as_map(id=F.col("seller_id"), first_name=F.col("first_name"), last_name=F.col("last_name"))
        return s.select(*_message(table, F.col("seller_id"), r, after, None, F.col("seller_id")))
    if table == "users":
        u = star.users(activity=True)
        after = _as_map(id=F.col("user_id"), age=F.col("user_age"), first_name=F.col("first_name"),
                        last_name=F.col("last_name"), date_joined=iso_text(F.col("date_joined")),
                        last_login=iso_text(F.col("last_login")))
        return u.select(*_message(table, F.col("user_id"), r, after, None, F.col("user_id")))
    if table == "payments":
        p = star.payments()
        after = _as_map(id=F.col("payment_id"), order_id=F.col("order_id"), amount=F.col("amount"),
                        currency=F.col("currency"), status=F.col("status"),
                        created_at=iso_text(F.col("created_at")))
        return p.select(*_message(table, F.col("order_id"), r, after, None, F.col("payment_id")))
    raise ValueError(f"no snapshot for table {table!r}")


def event_messages(events: DataFrame) -> DataFrame:
    """``events`` as a change stream of ``users`` (offset = event id)."""
    events = events.repartition("event_id")  # JSON encoding is CPU-bound
    op = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_OPS.items()],
                    F.lit("u"))
    ts = iso_text(F.col("ts"))
    after = F.when(
        op != "d",
        _as_map(id=F.col("user_id"), last_login=ts,
                date_joined=F.when(F.col("event_type") == "signup", ts), is_active=F.lit("true")),
    )
    before = F.when(op == "d", _as_map(id=F.col("user_id")))
    return events.select(*_message("users", F.col("user_id"), op, after, before, F.col("event_id")))


def order_status_updates(star, status: str = "paid") -> DataFrame:
    """Update messages (op ``u``) that mark orders with a completed payment.

    Offsets continue after the snapshot's (order id + 2^40), so the update is
    the later version of the order.
    """
    pay = star.payments().filter(F.col("status") == "completed")
    o = star.orders().join(pay.select("order_id"), "order_id", "left_semi")
    after = _as_map(id=F.col("order_id"), user_id=F.col("user_id"), status=F.lit(status),
                    created_at=iso_text(F.col("order_date")))
    return o.select(*_message("orders", F.col("order_id"), F.lit("u"), after, None,
                              F.col("order_id") + F.lit(1 << 40)))
