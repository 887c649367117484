"""The maintained violations equal the full check after every batch."""
import random

from marketlake.operators import violations as V

ITEM = "item_id long, order_id long, product_id long, seller_id long, quantity int"


def rows(df):
    return sorted((r.rule, r.item_id) for r in df.collect())


def test_batches_equal_the_full_check(spark):
    rng = random.Random(10)
    item = lambda i: (i, rng.randrange(20), rng.randrange(4), rng.choice([1, 2, 3, None]), rng.choice([1, 5, 0, 200]))
    items, orders, sellers = {i: item(i) for i in range(80)}, set(range(15)), {1, 2}
    frame = lambda d: spark.createDataFrame(list(d), ITEM)
    ids = lambda name, s: spark.createDataFrame([(x,) for x in s], f"{name} long")
    kept = spark.createDataFrame(rows(V.check(frame(items.values()), ids("order_id", orders), ids("seller_id", sellers))), "rule string, item_id long")
    for _ in range(3):
        changed = rng.sample(sorted(items), 8)
        old = [items[i] for i in changed]
        new = [item(i) for i in changed[:5]] + [item(max(items) + 1)]
        items = {i: r for i, r in items.items() if i not in changed} | {r[0]: r for r in new}
        orders_now, sellers_now = set(rng.sample(range(20), 14)), set(rng.sample([1, 2, 3], 2))
        after = (frame(items.values()), ids("order_id", orders_now), ids("seller_id", sellers_now))
        got = rows(V.maintain(kept, *after, frame(old), frame(new), ids("order_id", orders ^ orders_now), ids("seller_id", sellers ^ sellers_now)))
        assert got == rows(V.check(*after))
        kept = spark.createDataFrame(got, "rule string, item_id long")
        orders, sellers = orders_now, sellers_now


def test_only_touched_items_are_checked_again(spark):
    frame = lambda d: spark.createDataFrame(d, ITEM)
    items = frame([(1, 1, 1, 1, 1), (2, 1, 1, 1, 1), (3, 2, 1, 1, 1), (4, 3, 1, 2, 1)])
    none = spark.createDataFrame([], "order_id long"), spark.createDataFrame([], "seller_id long")
    touched = V.touched_items(items, frame([(2, 1, 9, 1, 1)]), frame([(2, 1, 1, 1, 1)]), *none)
    assert sorted(r.item_id for r in touched.collect()) == [1, 2]
