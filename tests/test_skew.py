"""Hot keys: one product with a third of all lines, forced sort-merge joins and
AQE skew splitting; results must equal the default plan's."""
import datetime as dt

from pyspark.sql import functions as F

from marketlake.operators import versioned as V
from marketlake.plans import reports as R


class _Star:
    """Synthetic star (test fixture only): product 0 is hot."""

    def __init__(self, spark, n=30000):
        self.spark = spark
        base = spark.range(n).withColumn("order_id", F.col("id") % 3000)
        self._items = base.select(
            "order_id",
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).cast("long").alias("product_id"),
            (F.col("id") % 11).cast("long").alias("seller_id"),
            (F.col("id") % 5 + 1).cast("int").alias("quantity"),
        )
        self._orders = spark.range(3000).select(
            F.col("id").alias("order_id"),
            F.expr("timestamp_ntz'2001-07-01 00:00:00' + make_interval(0, 0, 0, cast(id % 31 as int))").alias("order_date"),
            (F.col("id") % 200).alias("user_id"),
        )
        self._products = spark.range(98).select(
            F.col("id").alias("product_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_name"),
            F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("main_category"),
            F.lit("s").alias("sub_category"), (F.col("id") + F.lit(0.5)).cast("decimal(10,2)").alias("external_price"))

    def orders(self):
        return self._orders

    def order_items(self):
        return self._items

    def products(self):
        return self._products

    def sellers(self):
        return self.spark.range(11).select(F.col("id").alias("seller_id"), F.lit("s").alias("first_name"),
                                           F.col("id").cast("string").alias("last_name"))

    def users(self, activity=False):
        return self.spark.range(200).select(F.col("id").alias("user_id"), (F.col("id") % 60 + 18).cast("int").alias("user_age"))


def _collect(df):
    return sorted(tuple(r) for r in df.collect())


def test_reports_equal_under_forced_skew_handling(spark):
    star = _Star(spark)
    as_of = dt.datetime(2001, 8, 1)
    names = ["top_categories", "category_distribution", "top_sellers", "customer_age_distribution", "product_performance"]
    normal = {n: _collect(R.REPORTS[n](star, as_of=as_of)) for n in names}
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        forced = {n: _collect(R.REPORTS[n](star, as_of=as_of)) for n in names}
        plan = R.top_categories(star, as_of=as_of)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert forced == normal
    assert "SortMergeJoin" in text


def test_latest_version_hot_key(spark):
    df = spark.range(20000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"),
                                   F.col("id").alias("ver"))
    out = {r.k: r.ver for r in V.latest_version(df, ["k"], ["ver"]).collect()}
    assert out[0] == 19998 and len(out) == 1 + 20000 - 6667
