"""Stream tests on JSON files with availableNow: replay, poison row, restart."""
import datetime as dt
import json
import os

from pyspark.sql import functions as F

from marketlake.sources import stream as ST
from marketlake.sources.versioned_star import VersionedStar
from marketlake.streaming import cdc_pipeline as P


def _write(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        for topic, part, off, value in rows:
            f.write(json.dumps({"topic": topic, "partition": part, "offset": off, "value": value}) + "\n")


def _env(op, after):
    return json.dumps({"op": op, "after": after})


def test_stream_replay_poison_restart(spark, scratch):
    src, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    o = "postgres.public.orders"
    _write(src, "a.json", [
        (o, 0, 0, _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2024-01-15T10:30:00Z"})),
        (o, 0, 1, _env("u", {"id": 1, "user_id": 7, "status": "paid", "created_at": "2024-01-15T10:30:00Z"})),
        (o, 0, 2, "this is not json"),
        ("postgres.public.products", 0, 3, _env("c", {"id": 5, "product_name": "x", "external_price": "N/A"})),
    ])
    job = P.CdcJob(out, etl_ts=F.lit(dt.datetime(2024, 2, 1)).cast("timestamp"))
    q = P.start(ST.file_messages(spark, src), job, ckpt, {"availableNow": True})
    q.awaitTermination(120)
    star = VersionedStar(spark, f"{out}/tables")
    assert [(r.order_id, r.status) for r in star.orders().collect()] == [(1, "paid")]
    assert spark.read.parquet(f"{out}/quarantine/_messages").count() == 1
    assert spark.read.parquet(f"{out}/quarantine/products").count() == 1

    # second file: a replayed offset plus a new order; restart from the checkpoint
    _write(src, "b.json", [
        (o, 0, 1, _env("u", {"id": 1, "user_id": 7, "status": "paid", "created_at": "2024-01-15T10:30:00Z"})),
        (o, 0, 4, _env("c", {"id": 2, "user_id": 8, "status": "created", "created_at": "2024-01-16T00:00:00Z"})),
    ])
    q2 = P.start(ST.file_messages(spark, src), job, ckpt, {"availableNow": True})
    q2.awaitTermination(120)
    log = star.log("orders")
    assert log.count() == 3  # offsets 0, 1, 4 - the replay of offset 1 was dropped
    assert sorted((r.order_id, r.status) for r in star.orders().collect()) == [(1, "paid"), (2, "created")]
    assert spark.read.parquet(f"{out}/ledger").count() == 5


def test_batch_retry_is_idempotent(spark, scratch):
    out = f"{scratch}/out"
    rows = [("postgres.public.sellers", 0, 0, _env("r", {"id": 3, "first_name": "A", "last_name": "B"}))]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    job = P.CdcJob(out, tables=["sellers"])
    job.process(df, 0)
    job.process(df, 0)  # Spark re-runs a failed batch with the same id
    assert spark.read.parquet(f"{out}/tables/sellers").count() == 1


def test_live_reports_and_rollups(spark, scratch):
    out = f"{scratch}/out"
    o, it, p = "postgres.public.orders", "postgres.public.order_items", "postgres.public.products"
    rows = [
        (p, 0, 0, _env("r", {"id": 10, "product_name": "bolt", "main_category": "HW", "sub_category": "s",
                             "external_price": "2.50"})),
        (o, 0, 1, _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2001-07-15T00:00:00Z"})),
        (it, 0, 2, _env("c", {"order_id": 1, "product_id": 10, "seller_id": 3, "quantity": 4})),
    ]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    job = P.CdcJob(out, reports={"top_categories": P.R.top_categories}, as_of=dt.datetime(2001, 8, 1),
                   rollups=True)
    job.process(df, 0)
    rep = spark.read.parquet(f"{out}/reports/top_categories").collect()
    assert [(r.main_category, r.total_orders, r.total_revenue) for r in rep] == [("HW", 1, 10.0)]
    roll = spark.read.parquet(f"{out}/rollups/mv_top_categories_month").collect()
    assert len(roll) == 1 and roll[0].total_revenue == 10.0


def test_late_items_and_prices_refresh_old_months(spark, scratch):
    out = f"{scratch}/out"
    o, it, p = "postgres.public.orders", "postgres.public.order_items", "postgres.public.products"
    price = lambda v: _env("u", {"id": 10, "product_name": "bolt", "main_category": "HW", "sub_category": "s",
                                 "external_price": v})
    item = lambda i, q: _env("c", {"id": i, "order_id": 1, "product_id": 10, "seller_id": 3, "quantity": q})
    batches = [
        [(p, 0, 0, price("2.50")), (it, 0, 2, item(1, 4)),
         (o, 0, 1, _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2001-07-15T00:00:00Z"}))],
        [(it, 0, 3, item(2, 6))],
        [(p, 0, 4, price("3.00"))],
    ]
    job = P.CdcJob(out, as_of=dt.datetime(2001, 8, 1), rollups=True)
    seen = []
    for n, rows in enumerate(batches):
        job.process(spark.createDataFrame(rows, "topic string, partition int, offset long, value string"), n)
        r = spark.read.parquet(f"{out}/rollups/mv_top_categories_month").collect()
        seen.append([(x.total_orders, x.total_revenue) for x in r])
    assert seen == [[(1, 10.0)], [(2, 25.0)], [(2, 30.0)]]


def test_deletes_ignored_by_default_applied_on_request(spark, scratch):
    o = "postgres.public.orders"
    rows = [
        (o, 0, 0, _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2024-01-15T10:30:00Z"})),
        (o, 0, 1, _env("c", {"id": 2, "user_id": 8, "status": "created", "created_at": "2024-01-15T10:30:00Z"})),
        (o, 0, 2, json.dumps({"op": "d", "before": {"id": 1}, "after": None})),
    ]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    keep, drop = f"{scratch}/keep", f"{scratch}/drop"
    P.CdcJob(keep, tables=["orders"]).process(df, 0)
    P.CdcJob(drop, tables=["orders"], apply_deletes=True).process(df, 0)
    assert sorted(r.order_id for r in VersionedStar(spark, f"{keep}/tables").orders().collect()) == [1, 2]
    assert sorted(r.order_id for r in VersionedStar(spark, f"{drop}/tables").orders().collect()) == [2]


def test_dedup_within_watermark(spark, scratch):
    src = f"{scratch}/in"
    os.makedirs(src)
    with open(f"{src}/a.json", "w") as f:
        for off in (0, 1, 1, 2):
            f.write(json.dumps({"topic": "t", "partition": 0, "offset": off, "value": "{}",
                                "timestamp": "2024-01-01T00:00:0%d" % off}) + "\n")
    msgs = spark.readStream.schema("topic string, partition int, offset long, value string, timestamp timestamp") \
        .json(src)
    q = ST.dedup_within_watermark(msgs, "timestamp", "1 hour").writeStream.format("memory") \
        .queryName("dedup_test").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.offset for r in spark.sql("SELECT offset FROM dedup_test").collect()) == [0, 1, 2]


def test_report_date_filter_reaches_versioned_scan(spark, scratch):
    out = f"{scratch}/out"
    o = "postgres.public.orders"
    rows = [(o, 0, 1, _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2001-07-15T00:00:00Z"}))]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    P.CdcJob(out, tables=["orders"]).process(df, 0)
    plan = P.R.window_orders(VersionedStar(spark, f"{out}/tables"), "rolling", dt.datetime(2001, 8, 1)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(order_date,2001-07-01)" in plan


def test_compaction_snapshots_keep_results(spark, scratch):
    o = "postgres.public.orders"

    def batch(rows):
        return spark.createDataFrame(rows, "topic string, partition int, offset long, value string")

    def order(off, oid, status):
        return (o, 0, off, _env("u", {"id": oid, "user_id": 7, "status": status,
                                      "created_at": "2024-01-15T10:30:00Z"}))

    job = P.CdcJob(f"{scratch}/out", tables=["orders"], compact_every=2)
    job.process(batch([order(0, 1, "created"), order(1, 2, "created")]), 0)
    job.process(batch([order(2, 1, "paid")]), 1)          # compaction -> snapshots/orders/upto=1
    job.process(batch([order(3, 2, "cancelled")]), 2)     # after the snapshot
    snap = spark.read.parquet(f"{scratch}/out/snapshots/orders/upto=1")
    assert sorted((r.order_id, r.status) for r in snap.collect()) == [(1, "paid"), (2, "created")]
    with_snap = job.versioned(spark).orders()
    plain = VersionedStar(spark, f"{scratch}/out/tables").orders()
    expect = [(1, "paid"), (2, "cancelled")]
    assert sorted((r.order_id, r.status) for r in with_snap.collect()) == expect
    assert sorted((r.order_id, r.status) for r in plain.collect()) == expect


def test_orders_snapshot_prunes_by_date(spark, scratch):
    o = "postgres.public.orders"
    rows = [(o, 0, i, _env("c", {"id": i, "user_id": 7, "status": "created",
                                 "created_at": f"2001-0{6 + i % 2}-15T00:00:00Z"})) for i in range(4)]
    job = P.CdcJob(f"{scratch}/out", tables=["orders"], compact_every=1)
    job.process(spark.createDataFrame(rows, "topic string, partition int, offset long, value string"), 0)
    df = P.R.window_orders(job.versioned(spark), "rolling", dt.datetime(2001, 8, 1))
    assert sorted(r.order_id for r in df.collect()) == [1, 3]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_date" in plan and "(order_date#" in plan


def test_delete_compact_recreate(spark, scratch):
    o = "postgres.public.orders"

    def b(rows):
        return spark.createDataFrame(rows, "topic string, partition int, offset long, value string")

    created = _env("c", {"id": 1, "user_id": 7, "status": "created", "created_at": "2024-01-15T10:30:00Z"})
    job = P.CdcJob(f"{scratch}/out", tables=["orders"], apply_deletes=True, compact_every=2)
    job.process(b([(o, 0, 0, created), (o, 0, 1, _env("c", {"id": 2, "user_id": 8, "status": "created",
                                                            "created_at": "2024-01-15T10:30:00Z"}))]), 0)
    job.process(b([(o, 0, 2, json.dumps({"op": "d", "before": {"id": 1}, "after": None}))]), 1)  # + compaction
    assert sorted(r.order_id for r in job.versioned(spark).orders().collect()) == [2]
    snap = spark.read.parquet(f"{scratch}/out/snapshots/orders/upto=1")
    assert sorted(r.order_id for r in snap.collect()) == [2]
    job.process(b([(o, 0, 3, created)]), 2)  # the key comes back after the delete
    assert sorted(r.order_id for r in job.versioned(spark).orders().collect()) == [1, 2]
