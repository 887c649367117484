"""Clustered files are pruned for every column; sketches stay within their error."""
import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marketlake.operators import layout as LY
from marketlake.operators import sketches as SK


def overlapping(path, column, lo, hi):
    """How many files hold the range of the column by their statistics, and how many files there are."""
    files = glob.glob(f"{path}/*.parquet")
    hit = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == column)
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        hit += any(s is None or not (s.max < lo or s.min > hi) for s in stats)
    return hit, len(files)


def test_every_filter_reads_fewer_files(spark, scratch):
    df = spark.range(40_000).select(F.expr("date_add(DATE'2001-01-01', cast(id % 360 AS int))").alias("day"),
                                    F.pmod(F.xxhash64("id"), F.lit(1000)).alias("seller"),
                                    F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000))).alias("product"))
    LY.write_clustered(df, f"{scratch}/z", ["day", "seller", "product"], files=64)
    stored = spark.read.parquet(f"{scratch}/z")
    assert stored.count() == 40_000 and stored.exceptAll(df).isEmpty()
    import datetime as dt
    for column, lo, hi in (("day", dt.date(2001, 3, 1), dt.date(2001, 3, 20)), ("seller", 100, 140), ("product", 2000, 2200)):
        hit, files = overlapping(f"{scratch}/z", column, lo, hi)
        assert files >= 40 and hit <= files * 0.6, (column, hit, files)


def test_scaling_takes_nulls_and_one_value(spark):
    df = spark.createDataFrame([(None, 5), (1, 5), (9, 5)], "a int, b int")
    assert sorted(r.z for r in df.select(LY.z_order(df, ["a", "b"], 2).alias("z")).collect()) == [0, 0, 10]


def test_any_window_of_daily_sketches(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("user"))
    daily = SK.daily_sketches(rows, "day", "user").cache()
    for lo, hi in ((0, 0), (3, 9), (0, 29)):
        inside = F.col("day").between(lo, hi)
        exact = rows.where(inside).select(F.count_distinct("user").alias("n")).first().n
        guess = SK.distinct_estimate(daily, inside).first().estimate
        assert abs(guess - exact) <= 4 * SK.standard_error() * exact + 1
    assert SK.distinct_estimate(daily.limit(0)).first().estimate in (None, 0)
