"""FIXTURES section 6: catalog and order job vectors."""
from decimal import Decimal

from pyspark.sql import functions as F

from marketlake.operators import catalog as CAT
from marketlake.operators import orders as ORD


def test_expand_variants(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    options = spark.createDataFrame([(10, 1), (11, 1)], "option_id long, product_id long")
    items = spark.createDataFrame([(100, 10), (101, 10), (110, 11), (111, 11), (112, 11)],
                                  "item_id long, option_id long")
    v = CAT.expand_variants(products, options, items).collect()
    p1 = sorted((r.option1, r.option2, r.option3, r.combo) for r in v if r.product_id == 1)
    assert len(p1) == 6 and all(r[2] is None for r in p1)
    assert sorted(r[3] for r in p1) == list(range(6))
    p2 = [(r.option1, r.option2, r.option3) for r in v if r.product_id == 2]
    assert p2 == [(None, None, None)]


def test_price_range(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    variants = spark.createDataFrame([(1, 10.0), (1, 50.0)], "product_id long, price double")

    def ids(lo, hi):
        return sorted(r.product_id for r in CAT.price_range_semi(products, variants, lo, hi).collect())

    assert ids(5, 60) == [1] and ids(20, 60) == [] and ids(5, 40) == []
    assert ids(None, None) == [1, 2]


def test_paginate(spark):
    df = spark.range(25).withColumnRenamed("id", "product_id")
    p3 = CAT.paginate(df, 3, 12).collect()
    assert len(p3) == 1 and p3[0].pages == 3 and p3[0].total == 25 and p3[0].product_id == 24
    empty = CAT.paginate(df.filter("product_id < 0"), 1, 12)
    assert empty.count() == 0
    assert df.filter("product_id < 0").select(F.count(F.lit(1)).alias("t")).select(
        ((F.col("t") + 11) / 12).cast("long")).first()[0] == 0


def test_text_and_status_filters(spark):
    df = spark.createDataFrame([(1, "Blue Bolt", "x", "active"), (2, "gear", "has BOLT", "draft"),
                                (3, "nut", "y", "archived")],
                               "product_id long, product_name string, description string, status string")
    pred = CAT.conjunctive(CAT.status_in("active,draft"), CAT.text_contains("bolt"))
    assert sorted(r.product_id for r in df.filter(pred).collect()) == [1, 2]
    assert CAT.conjunctive(None, None) is None


def test_seller_arrays_and_permissions(spark):
    products = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "product_id long, seller_id long")
    sellers = spark.createDataFrame([(7, 70), (8, 80), (9, 90)], "seller_id long, user_id long")
    arr = {r.seller_id: r.product_ids for r in CAT.seller_product_ids(products, sellers).collect()}
    assert arr == {7: [1, 2], 8: [3], 9: None}
    users = spark.createDataFrame([(70, "seller"), (80, "seller"), (1, "admin"), (2, "user")],
                                  "user_id long, role string")
    req = spark.createDataFrame([(70, 1), (70, 3), (1, 3), (2, 1)], "user_id long, product_id long")
    got = {(r.user_id, r.product_id): r.allowed for r in CAT.edit_permission(req, users, sellers, products).collect()}
    assert got == {(70, 1): True, (70, 3): False, (1, 3): True, (2, 1): False}
    assert df_first(spark.range(1).select(CAT.append_unique(F.array(F.lit(1)), F.lit(2)))) == [1, 2]
    assert df_first(spark.range(1).select(CAT.append_unique(F.array(F.lit(1)), F.lit(1)))) == [1]


def df_first(df):
    return df.first()[0]


def _order_fixture(spark, lines):
    variants = spark.createDataFrame([(1, 1, Decimal("10.00"), 5)],
                                     "variant_id long, product_id long, price decimal(12,2), stock int")
    products = spark.createDataFrame([(1, 3)], "product_id long, seller_id long")
    sellers = spark.createDataFrame([(3,)], "seller_id long")
    df = spark.createDataFrame(lines, "request_id long, line_no int, variant_id long, quantity int, order_ts timestamp")
    return df, variants, products, sellers


def test_order_validation_modes(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df, v, p, s = _order_fixture(spark, [(1, 1, 1, 3, t), (1, 2, 1, 3, t)])
    per_line = ORD.validate_orders(df, v, p, s, cumulative=False).collect()
    assert all(r.accepted for r in per_line)
    lines, orders = ORD.price_orders(ORD.validate_orders(df, v, p, s, cumulative=False))
    assert orders.first().total_amount == Decimal("60.00")
    assert ORD.decrement_stock(v, lines).first().stock == -1  # defect B13 reproduced
    cum = ORD.validate_orders(df, v, p, s, cumulative=True).collect()
    assert not any(r.accepted for r in cum) and cum[0].order_error == "insufficient stock"


def test_a_refused_order_leaves_its_stock(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    hours = [t + dt.timedelta(hours=h) for h in range(6)]
    # stock 5: too large; takes 3; does not fit; takes 2; nothing left; repeats one variant in an order
    df, v, p, s = _order_fixture(spark, [(1, 1, 1, 9, hours[0]), (2, 1, 1, 3, hours[1]), (3, 1, 1, 3, hours[2]),
                                         (4, 1, 1, 1, hours[3]), (4, 2, 1, 1, hours[3]), (5, 1, 1, 1, hours[4])])
    res = {r.request_id: (r.accepted, r.order_error) for r in ORD.validate_orders(df, v, p, s).collect()}
    no = (False, "insufficient stock")
    assert res == {1: no, 2: (True, None), 3: no, 4: (True, None), 5: no}


def test_allocation_equals_a_replay(spark):
    import datetime as dt
    import random
    rng = random.Random(5)
    stock = {v: rng.randrange(0, 40) for v in range(12)}
    rows = []
    for r in range(300):
        ts = dt.datetime(2024, 1, 1 + rng.randrange(3))
        for v in rng.sample(range(12), rng.randrange(1, 4)):
            v = 0 if rng.random() < 0.3 else v  # a hot variant
            rows.append((r, v, rng.randrange(1, 9), ts))
    merged = {}
    first = {}
    for r, v, q, ts in rows:
        merged[(r, v)] = merged.get((r, v), 0) + q
        first[r] = ts
    left, given = dict(stock), set()
    for r in sorted(first, key=lambda r: (first[r], r)):
        want = {v: q for (o, v), q in merged.items() if o == r}
        if all(left[v] >= q for v, q in want.items()):
            given.add(r)
            for v, q in want.items():
                left[v] -= q
    demand = spark.createDataFrame([(r, v, q, stock[v], first[r]) for (r, v), q in merged.items()],
                                   "request_id long, variant_id long, qty long, stock long, ts timestamp")
    assert {x.request_id for x in ORD.allocate(demand, bucket_bits=4).collect()} == given


def test_too_many_options_are_rejected_not_cut(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    options = spark.createDataFrame([(i, 1 if i < 4 else 2) for i in range(8)], "option_id long, product_id long")
    items = spark.createDataFrame([(i, i) for i in range(8)], "item_id long, option_id long")
    few = options.where("option_id <> 3")
    assert {r.product_id for r in CAT.expand_variants(products, few, items).collect()} == {1}
    assert [(r.product_id, r.n_options) for r in CAT.option_rejects(few).collect()] == [(2, 4)]


def test_zero_max_price_is_no_bound(spark):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    variants = spark.createDataFrame([(1, 5.0), (2, 9.0)], "product_id long, price double")
    assert CAT.price_range_semi(products, variants, 6, 0).collect()[0].product_id == 2


def test_order_rejections(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df, v, p, s = _order_fixture(spark, [(1, 1, 1, 0, t), (2, 1, 1, 101, t), (3, 1, 99, 1, t), (3, 2, 1, 1, t),
                                         (4, 1, 1, 2, t)])
    res = {r.request_id: (r.accepted, r.order_error) for r in ORD.validate_orders(df, v, p, s).collect()}
    assert res[1] == (False, "quantity out of range")
    assert res[2] == (False, "quantity out of range")
    assert res[3] == (False, "variant not found")
    assert res[4] == (True, None)


def test_payments(spark):
    orders = spark.createDataFrame([(1, 7, Decimal("60.00"))], "order_id long, user_id long, total_amount decimal(12,2)")
    req = spark.createDataFrame([(1, 7, "card"), (1, 8, "card"), (2, 7, "paypal"), (1, 7, "cash")],
                                "order_id long, user_id long, method string")
    out = [(r.user_id, r.method, r.status, r.reject_reason) for r in
           ORD.apply_payments(req, orders).orderBy("order_id", "user_id", "method").collect()]
    assert (7, "card", "completed", None) in out
    assert (8, "card", None, "order not found") in out
    assert (7, "paypal", None, "order not found") in out
    assert (7, "cash", None, "invalid method") in out


def test_running_demand_matches_global_window(spark):
    import datetime as dt
    from pyspark.sql import Window
    rows = [(i, i % 3, dt.datetime(2024, 1, 1 + i % 5, i % 24), i % 7 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp, q int")
    two_level = ORD.running_demand(df, "k", ["ts", "id"], "q", F.to_date("ts"))
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    direct = df.withColumn("demand", F.sum("q").over(w))
    a = sorted((r.id, r.demand) for r in two_level.collect())
    b = sorted((r.id, r.demand) for r in direct.collect())
    assert a == b


def test_invariant_accepted_quantity_within_stock(spark):
    from conftest import SF01
    from marketlake.plans import order_queries as OQ
    from marketlake.sources.testdata import Star
    v = OQ._validated(spark, SF01)
    lines, _ = ORD.price_orders(v)
    star = Star(spark, SF01)
    left = ORD.decrement_stock(star.variants(), lines)
    assert left.filter(F.col("stock") < 0).count() == 0  # cumulative mode never oversells
    assert lines.count() > 0


def test_invariant_latest_version_unique(spark):
    from conftest import SF01
    from marketlake.operators import versioned as V
    from marketlake.sources.testdata import Star
    ev = Star(spark, SF01).raw("events")
    out = V.latest_version(ev, ["user_id"], ["ts", "event_id"])
    assert out.count() == out.select("user_id").distinct().count() == ev.select("user_id").distinct().count()


def test_search_document_constants_switch(spark):
    import datetime as dt
    products = spark.createDataFrame([(1, "bolt", None, "active", dt.datetime(2024, 1, 1), 4.2, "HW")],
                                     "product_id long, product_name string, description string, status string, "
                                     "created_at timestamp_ntz, external_ratings double, main_category string")
    variants = spark.createDataFrame([(1, 10, Decimal("9.50"), 3), (1, 11, Decimal("8.00"), 1)],
                                     "product_id long, variant_id long, price decimal(12,2), stock int")
    media = spark.createDataFrame([(1, 5, "b.jpg"), (1, 4, "a.jpg")], "product_id long, media_id long, src string")
    a = CAT.search_document(products, variants, media, constants=True).first()
    b = CAT.search_document(products, variants, media, constants=False).first()
    assert (a.rating, a.category, a.price, a.stock, a.image_url, a.description) == (4.5, "general", 9.5, 3, "a.jpg", "")
    assert (b.rating, b.category) == (4.2, "HW")
    assert a.created_at == "2024-01-01T00:00:00"


def test_visible_products_parameter(spark):
    df = spark.createDataFrame([(1, "active", 7), (2, "published", 7), (3, "active", 8)],
                               "product_id long, status string, seller_id long")
    assert sorted(r.product_id for r in CAT.visible_products(df).collect()) == [1, 3]
    assert [r.product_id for r in CAT.visible_products(df, seller_id=8).collect()] == [3]
    assert [r.product_id for r in CAT.visible_products(df, visible_status="published").collect()] == [2]
