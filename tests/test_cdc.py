"""FIXTURES section 5: change-stream vectors (batch path) and W1 ties."""
import datetime as dt
import json

from pyspark.sql import functions as F

from marketlake.operators import cdc as CDC
from marketlake.operators import versioned as V

T0 = dt.datetime(2024, 2, 1)


def _msg(topic, offset, op, after=None, partition=0, raw=None):
    value = raw if raw is not None else json.dumps({"op": op, "after": after})
    return (topic, partition, offset, value)


VECTORS = [
    _msg("postgres.public.orders", 0, "c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2024-01-15T10:30:00Z"}),
    _msg("postgres.public.orders", 1, "u", {"id": 1, "user_id": 7, "status": "paid", "created_at": "2024-01-15T10:30:00Z"}),
    _msg("postgres.public.orders", 2, "d", None),
    _msg("postgres.public.products", 3, "c", {"id": 5, "product_name": "x", "external_price": "N/A"}),
    _msg("postgres.public.product_variants", 4, "c", {"id": 9}),
    _msg("other.topic", 5, "c", {"id": 1}),
    _msg("postgres.public.orders", 0, "c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2024-01-15T10:30:00Z"}),
    _msg("postgres.public.users", 6, "r", {"id": 7, "age": 30, "last_login": None}),
    _msg("postgres.public.users", 7, None, raw="not json"),
]


def _frame(spark):
    return spark.createDataFrame(VECTORS, "topic string, partition int, offset long, value string")


def test_decode_statuses(spark):
    d = CDC.decode(CDC.dedup_replays(_frame(spark)))
    got = {(r.offset, r.status) for r in d.collect()}
    assert got == {(0, "ok"), (1, "ok"), (2, "delete"), (3, "ok"), (4, "unmapped"),
                   (5, "unknown_topic"), (6, "ok"), (7, "bad_json")}


def test_orders_latest_and_quarantine(spark):
    d = CDC.decode(CDC.dedup_replays(_frame(spark)))
    etl = F.lit(T0).cast("timestamp")
    orders, bad_orders = CDC.split_rejects(CDC.to_table(d, "orders", etl))
    assert bad_orders.count() == 0
    snap = V.latest_version(orders, ["order_id"], ["etl_updated_at", "_offset"]).collect()
    assert len(snap) == 1 and snap[0].status == "paid" and snap[0].order_date == dt.date(2024, 1, 15)
    products, bad = CDC.split_rejects(CDC.to_table(d, "products", etl))
    assert products.count() == 0 and bad.first().reject_reason == "bad external_price"
    users, _ = CDC.split_rejects(CDC.to_table(d, "users", etl))
    u = users.first()
    assert u.user_id == 7 and u.user_age == 30 and u.last_login is None
    dead = CDC.dead_letters(d).collect()
    assert [(r.offset, r.reject_reason) for r in dead] == [(7, "bad_json")]


def test_latest_version_tie_on_offset(spark):
    df = spark.createDataFrame([(1, T0, 5, "a"), (1, T0, 6, "b"), (2, T0, 1, "c")],
                               "k long, v timestamp, off long, payload string")
    out = {r.k: r.payload for r in V.latest_version(df, ["k"], ["v", "off"]).collect()}
    assert out == {1: "b", 2: "c"}


def test_ledger_anti_join(spark):
    msgs = _frame(spark)
    ledger = CDC.ledger_rows(msgs.filter("offset < 3"))
    left = CDC.unseen(CDC.dedup_replays(msgs), ledger)
    assert sorted(r.offset for r in left.collect()) == [3, 4, 5, 6, 7]


def test_patch_update(spark):
    target = spark.createDataFrame([(1, "a", "x", T0), (2, "b", "y", T0)],
                                   "id long, name string, city string, updated_at timestamp")
    patches = spark.createDataFrame([(1, None, "z")], "id long, name string, city string")
    later = dt.datetime(2024, 3, 1)
    out = {r.id: r for r in V.patch_update(target, patches, ["id"], F.lit(later).cast("timestamp")).collect()}
    assert out[1].name == "a" and out[1].city == "z" and out[1].updated_at == later
    assert out[2].city == "y" and out[2].updated_at == T0


def test_merge_latest(spark):
    base = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "k long, v string, ver int")
    changes = spark.createDataFrame([(1, "new", 2)], "k long, v string, ver int")
    out = {r.k: r.v for r in V.merge_latest(base, changes, ["k"], ["ver"]).collect()}
    assert out == {1: "new", 2: "keep"}


def test_golden_latest_event_per_user(spark):
    from marketlake.sources.testdata import Star
    from conftest import SF01
    ev = Star(spark, SF01).raw("events").select("user_id", "event_id", "ts", "event_type")
    out = V.latest_version(ev, ["user_id"], ["ts", "event_id"])
    rows = {r.user_id: r for r in out.collect()}
    assert len(rows) == 150 and rows[0].event_id == 9907 and rows[0].event_type == "purchase"


def test_topic_set_algebra(spark):
    from marketlake.sources import stream as ST
    mk = lambda xs: spark.createDataFrame([(x,) for x in xs], "topic string")
    got = ST.new_topics(mk(["a", "b", "c"]), mk(["b", "c", "d"]), mk(["c"])).collect()
    assert [r.topic for r in got] == ["b"]


def test_compact_rewrites_latest_snapshot(spark, scratch):
    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, ver int")
    V.compact(log, ["k"], ["ver"], f"{scratch}/snap")
    got = {r.k: r.v for r in spark.read.parquet(f"{scratch}/snap").collect()}
    assert got == {1: "b", 2: "c"}
