"""FIXTURES section 4 vectors for the cleaners."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from marketlake.functions import cleaning as C
from marketlake.functions import dates as D

REJ = "REJ"
# input, N1, N2 (raw text, '0.0*' = failure zeroes both), N3
MONEY = [
    ("₹1,299.50", Decimal("1299.50"), 1299.5, None),
    ("999.99", Decimal("999.99"), 999.99, 999.99),
    ("", Decimal("0.00"), 0.0, None),
    (None, Decimal("0.00"), 0.0, None),
    ("N/A", REJ, 0.0, None),
    ("Get", REJ, 0.0, None),
    ("1,299", Decimal("1299.00"), 1299.0, 1.299),
    ("30,227", Decimal("30227.00"), 30227.0, 30.227),
    ("1.2.3", REJ, 0.0, None),
    ("5.", Decimal("5.00"), 5.0, 5.0),
    (".5", Decimal("0.50"), 0.5, 0.5),
    (".", REJ, 0.0, None),
    ("-5.00", Decimal("5.00"), -5.0, 5.0),
    ("1 299,00", Decimal("129900.00"), 0.0, 1299.0),
    ("1e3", Decimal("13.00"), 1000.0, 13.0),
    ("12345678901.00", REJ, 12345678901.0, 12345678901.0),
    ("19.995", Decimal("20.00"), 19.995, 19.995),
]


def test_money_cleaners(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MONEY)], "i int, v string")
    p, d = C.clean_money_rupee(F.col("v"), F.lit("1"))
    rows = df.select(
        "i", C.clean_money_digits("v").alias("n1"), C.clean_money_digits_reject("v").alias("rej"),
        p.alias("n2"), C.clean_number_comma_decimal("v").alias("n3"),
    ).orderBy("i").collect()
    for r, (text, n1, n2, n3) in zip(rows, MONEY):
        if n1 == REJ:
            assert r.rej and r.n1 is None, text
        else:
            assert not r.rej and r.n1 == n1, text
        assert r.n2 == n2, text
        assert r.n3 == n3, text


def test_rupee_failure_zeroes_both(spark):
    df = spark.createDataFrame([("₹100", "bad"), ("₹1,000", "₹900")], "p string, d string")
    p, d = C.clean_money_rupee(F.col("p"), F.col("d"))
    assert [tuple(r) for r in df.select(p, d).collect()] == [(0.0, 0.0), (1000.0, 900.0)]


def test_currency_and_counts(spark):
    df = spark.createDataFrame([(None,), ("",), (" eur ",), ("   ",)], "v string")
    assert [r[0] for r in df.select(C.normalize_currency("v")).collect()] == ["USD", "USD", "EUR", ""]
    df2 = spark.createDataFrame([("30,227",), (None,), ("12.7",)], "v string")
    assert [r[0] for r in df2.select(C.count_strip_commas("v")).collect()] == [30227, None, None]
    assert [r[0] for r in df2.select(C.count_from_float("v")).collect()] == [30, 0, 12]


def test_status_and_defaults(spark):
    df = spark.createDataFrame([("active",), ("published",), (None,)], "s string")
    assert [r[0] for r in df.select(C.status_default("s")).collect()] == ["active", "draft", None]
    df2 = spark.createDataFrame([(None,), (30,)], "a int")
    assert [r[0] for r in df2.select(C.default_age("a")).collect()] == [21, 30]


DATES = [
    ("2024-01-15T10:30:00Z", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 30)),
    ("2024-01-15T10:30:00.123456Z", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 30, 0, 123456)),
    ("2024-01-15T23:30:00+05:00", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 18, 30)),
    ("2024-01-15", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15)),
    (None, None, None),
    ("", None, None),
    ("garbage", REJ, None),
    ("1705314600", REJ, None),
    ("123456", REJ, None),
]


def test_iso_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, v string")
    rows = df.select(
        "i", D.iso_to_date(F.col("v")).alias("d"), D.iso_reject(F.col("v")).alias("rej"),
        D.iso_to_timestamp(F.col("v")).cast("timestamp_ntz").alias("ts"),
    ).orderBy("i").collect()
    for r, (text, d, ts) in zip(rows, DATES):
        if d == REJ:
            assert r.rej and r.d is None, text
        else:
            assert not r.rej and r.d == d, text
        assert r.ts == ts, text


def test_connect_decimal(spark):
    df = spark.createDataFrame([("AYaf", 2), ("/w==", 0)], "v string, s int")
    a = df.filter("s = 2").select(C.connect_decimal(F.col("v"), 2)).first()[0]
    b = df.filter("s = 0").select(C.connect_decimal(F.col("v"), 0)).first()[0]
    assert a == Decimal("999.99") and b == Decimal("-1")


def test_transaction_id_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    t1 = df.select(C.transaction_id("a", "b")).first()[0]
    t2 = df.select(C.transaction_id("a", "b")).first()[0]
    assert t1 == t2 and t1.startswith("txn_") and len(t1) == 36


def test_time_filters_edges(spark):
    df = spark.createDataFrame([(dt.date(2001, 6, 30),), (dt.date(2001, 7, 1),), (dt.date(2001, 8, 1),)], "d date")
    kept = D.rolling_month_filter(df, "d", dt.datetime(2001, 8, 1)).collect()
    assert [r.d for r in kept] == [dt.date(2001, 7, 1), dt.date(2001, 8, 1)]
    rng = D.time_range_filter(df, "d", dt.datetime(2001, 7, 1), dt.datetime(2001, 7, 31, 12)).collect()
    assert [r.d for r in rng] == [dt.date(2001, 7, 1)]
    cal = D.calendar_month_filter(df, "d", dt.datetime(2001, 8, 20)).collect()
    assert len(cal) == 2
    assert D.add_months(dt.datetime(2001, 3, 31), -1) == dt.datetime(2001, 2, 28)


def test_connector_decimals_in_registry(spark):
    from marketlake.functions import registry as REG
    from marketlake.operators import cdc as CDC
    import json

    rows = [("postgres.public.payments", 0, i, json.dumps({"op": "c", "after": {"id": i, "order_id": 1, "amount": a}}))
            for i, a in enumerate(["AYaf", "12.50", "N/A", "AQAAAAAAAAAAAA==", "nA=="])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    read = lambda: {r.payment_id: (r.amount, r.reject_reason)
                    for r in CDC.to_table(CDC.decode(df), "payments", F.current_timestamp()).collect()}
    REG.use_plain_decimals()
    try:
        assert read()[1] == (Decimal("12.50"), None)
    finally:
        REG.reset_transforms()
    out = read()
    assert out[3] == (None, "bad amount") and out[4] == (Decimal("-1.00"), None)
    assert out[0] == (Decimal("999.99"), None)
    assert out[1] == (Decimal("12.50"), None)
    assert out[2][0] is None and out[2][1] == "bad amount"


def test_iso_format_like_python(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 120),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(D.iso_format("t")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5).isoformat(), dt.datetime(2024, 1, 2, 3, 4, 5, 120).isoformat()]
