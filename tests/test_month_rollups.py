"""The roll-ups kept by signed deltas equal the live reports after every batch."""
import datetime as dt
import json

from marketlake.operators import deltas as X
from marketlake.plans import reports as R
from marketlake.streaming import cdc_pipeline as P

AS_OF = dt.datetime(2001, 8, 20)
MESSAGE = "topic string, partition int, offset long, value string"


class Feed:
    """Change messages with running offsets."""

    def __init__(self):
        self.at = 0

    def __call__(self, table, op, **row):
        self.at += 1
        image = {"before": row, "after": None} if op == "d" else {"after": row}
        return ("postgres.public." + table, 0, self.at, json.dumps({"op": op, **image}))

    def order(self, i, user, day, op="c"):
        return self("orders", op, id=i, user_id=user, status="created", created_at=f"2001-{day}T00:00:00Z")

    def item(self, i, order, product, seller, n, op="c"):
        return self("order_items", op, id=i, order_id=order, product_id=product, seller_id=seller, quantity=n)

    def product(self, i, price, category="HW"):
        return self("products", "u", id=i, product_name=f"p{i}", main_category=category, sub_category="s",
                    external_price=price)

    def person(self, i, age):
        return self("users", "u", id=i, age=age, user_age=age, first_name=f"u{i}", last_name="x", is_active=True)

    def seller(self, i, name):
        return self("sellers", "u", id=i, first_name=name, last_name="y")


def batches():
    f = Feed()
    return [
        [f.product(10, "2.50"), f.product(11, "4.00", "SW"), f.seller(3, "ann"), f.seller(4, "bo"),
         f.person(7, 20), f.person(8, 40),
         f.order(1, 7, "07-15"), f.order(2, 8, "08-02"), f.order(3, 7, "07-20"),
         f.item(1, 1, 10, 3, 4), f.item(2, 1, 11, 4, 1), f.item(3, 2, 10, 3, 2), f.item(4, 3, 10, 3, 5)],
        [f.item(1, 1, 10, 3, 9, "u"), f.item(5, 2, 11, 3, 1),                   # other quantity, late item
         f.item(4, 2, 10, 3, 5, "u")],                                          # item moves to another month's order
        [f.order(2, 7, "08-02", "u"), f.product(11, "5.00", "HW"), f.seller(4, "bob")],  # other user, price, name
        [f("orders", "d", id=1), f("order_items", "d", id=5)],                  # July is empty now
        [f.order(1, 8, "07-15"), f.item(7, 1, 10, 3, 1), f.person(8, 41)],      # the order comes back
    ]


def rows(df):
    return sorted(tuple(sorted(r.asDict().items())) for r in df.select(*[c for c in df.columns]).collect())


def test_every_batch_equals_the_live_report(spark, scratch):
    job = P.CdcJob(f"{scratch}/out", as_of=AS_OF, rollups=True, apply_deletes=True, compact_every=2)
    seen = []
    for n, messages in enumerate(batches()):
        frame = spark.createDataFrame(messages, MESSAGE)
        job.process(frame, n)
        if n == 1:
            job.process(frame, n)  # a batch that Spark runs again, after its compaction
        star = job.versioned(spark)
        for name in X.ROLLUPS if n == 3 else X.ROLLUPS[n:n + 1]:
            live = getattr(R, name)(star, as_of=AS_OF)
            kept = spark.read.parquet(f"{scratch}/out/rollups/{name}").select(live.columns)
            assert rows(kept) == rows(live), (n, name)
        kept = spark.read.parquet(f"{scratch}/out/rollups/mv_sales_metrics_month")
        seen.append({str(r.month): (r.total_orders, r.total_revenue) for r in kept.collect()})
    july, august = "2001-07-01", "2001-08-01"
    assert seen == [{july: (3, 26.5), august: (1, 5.0)}, {july: (2, 26.5), august: (3, 21.5)},
                    {july: (2, 27.5), august: (3, 22.5)}, {august: (2, 17.5)}, {july: (3, 30.0), august: (2, 17.5)}]


def test_a_batch_reads_only_touched_keys(spark, scratch):
    job = P.CdcJob(f"{scratch}/out", as_of=AS_OF, rollups=True, apply_deletes=True)
    for n, messages in enumerate(batches()[:2]):
        job.process(spark.createDataFrame(messages, MESSAGE), n)
    cells = spark.read.parquet(f"{scratch}/out/rollup_cells/delta/batch_id=1")
    # one line's units rise by five, one moves from July to August, one is new: nothing else is written
    assert sorted((r.month.month, r.product_id, r.n, r.qty) for r in cells.collect()) == [
        (7, 10, -1, 0), (8, 10, 1, 5), (8, 11, 1, 1)]
    star = job.versioned(spark)
    touched = star.live_of("order_items", star.touched("order_items", 1), 0)
    assert sorted(r.order_item_id for r in touched.collect()) == [1, 4]


def test_switched_on_late(spark, scratch):
    some = batches()
    P.CdcJob(f"{scratch}/out", apply_deletes=True).process(spark.createDataFrame(some[0], MESSAGE), 0)
    job = P.CdcJob(f"{scratch}/out", as_of=AS_OF, rollups=True, apply_deletes=True)
    job.process(spark.createDataFrame(some[1], MESSAGE), 1)
    live = R.mv_top_sellers_month(job.versioned(spark), as_of=AS_OF)
    assert rows(spark.read.parquet(f"{scratch}/out/rollups/mv_top_sellers_month").select(live.columns)) == rows(live)


def test_signed_images_cancel(spark):
    old = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 3, 4), (5, 6, 7, 8)], "order_id long, product_id long, seller_id long, quantity int")
    new = spark.createDataFrame([(1, 2, 3, 4), (5, 6, 7, 9)], old.schema)
    got = sorted((r.order_id, r.quantity, r.w) for r in X.signed(old, new, X._ITEM).collect())
    assert got == [(1, 4, -1), (5, 8, -1), (5, 9, 1)]
