"""Integrity checks on small fixtures."""

from marketlake.operators import quality as Q


def test_keys_and_references(spark):
    child = spark.createDataFrame([(1, 10), (2, 11), (3, None), (3, 10)], "id long, parent long")
    parent = spark.createDataFrame([(10,)], "pid long")
    assert [r.id for r in Q.unique_key(child, ["id"]).collect()] == [3]
    assert [r.id for r in Q.foreign_key(child, ["parent"], parent, ["pid"]).collect()] == [2]


def test_null_domain_range(spark):
    df = spark.createDataFrame([(1, "a", "paid", 5), (None, None, "weird", 0), (3, "c", None, 101)],
                               "id long, name string, status string, qty int")
    nn = Q.not_null(df, ["id", "name"]).collect()
    assert len(nn) == 1 and nn[0].null_columns == ["id", "name"]
    assert Q.domain_check(df, "status", Q.DOMAINS["order_status"]).count() == 1
    rr = Q.range_check(df, Q.standard_ranges(quantity="qty")).collect()
    assert sorted(r.qty for r in rr) == [0, 101]


def test_option_rules(spark):
    options = spark.createDataFrame(
        [(1, 1, "Size"), (2, 1, "Size"), (3, 2, "A"), (4, 2, "B"), (5, 2, "C"), (6, 2, "D"), (7, 3, "X")],
        "option_id long, product_id long, option_name string")
    items = spark.createDataFrame([(1, 1, "S"), (2, 2, "M"), (3, 3, "x"), (4, 4, "x"), (5, 5, "y"), (6, 6, "z")],
                                  "item_id long, option_id long, item_name string")
    got = {(r.product_id, r.rule) for r in Q.option_rules(options, items).collect()}
    assert got == {(1, "duplicate_option_name"), (2, "too_many_options"), (2, "duplicate_item_name"),
                   (3, "option_without_items")}


def test_reconcile(spark):
    orders = spark.createDataFrame([(1, 10.0), (2, 5.0)], "order_id long, total_amount double")
    lines = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 1.0)], "order_id long, line_total double")
    pays = spark.createDataFrame([(1, 10.0)], "order_id long, amount double")
    assert [r.order_id for r in Q.reconcile_totals(orders, lines).collect()] == [2]
    assert [r.order_id for r in Q.reconcile_totals(orders, lines, pays).collect()] == [2]


def test_stored_totals_are_reconciled(spark, tmp_path):
    from marketlake.plans import registry

    spark.createDataFrame([(1, 106.0), (2, 50.0), (3, 0.0), (4, 7.0)], "o_orderkey long, o_totalprice double") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 100.0, 0.06, 0.0), (2, 40.0, 0.0, 0.0), (2, 20.0, 0.0, 0.5), (2, 1.0, 0.0, 0.0)],
                          "l_orderkey long, l_extendedprice double, l_tax double, l_discount double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["reconcile_stored_totals"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(2, 3, 50.0), (4, 0, 7.0)]
