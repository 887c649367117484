"""The ledger of processed messages as offset intervals.

One row a message for ever grows with the history; intervals grow with its gaps. Offsets of a
topic partition are merged into disjoint closed ranges [lo, hi] (gaps and islands), and a
batch is checked against them by an as-of join: a message was processed if the last range that
begins at or before its offset reaches it. Both work per offset bucket, so a
topic partition with a third of all messages is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join, by_range

PART = ["topic", "partition"]
RANGES = "topic string, partition int, lo bigint, hi bigint"
WIDTH = 1 << 16


def intervals(offsets: DataFrame, width: int = WIDTH) -> DataFrame:
    """(topic, partition, lo, hi): the disjoint ranges of the offsets, adjacent ones joined; repeats count once.

    Islands are found inside offset buckets first; only a bucket's ranges meet those of others.
    """
    rows = offsets.select("topic", F.col("partition").cast("int").alias("partition"),
                          F.col("offset").cast("bigint").alias("offset")).distinct()
    rows = rows.withColumn("_b", by_range(width)(F.col("offset")))
    place = F.row_number().over(Window.partitionBy(*PART, "_b").orderBy("offset"))
    rows = rows.withColumn("_island", F.col("offset").cast("decimal(20,0)") - place)
    inside = rows.groupBy(*PART, "_b", "_island").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    return merged(inside.select(*PART, "lo", "hi"))


def merged(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjacent ranges joined: as many rows as the history has gaps, and one."""
    before = Window.partitionBy(*PART).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("hi").over(before)
    rows = ranges.withColumn("_new", (reach.isNull() | (F.col("lo").cast("decimal(20,0)") > reach + F.lit(1).cast("decimal(1,0)")))
                             .cast("int"))
    upto = Window.partitionBy(*PART).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.sum("_new").over(upto))
    return rows.groupBy(*PART, "_at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_at")


def unprocessed(messages: DataFrame, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """Range anti-join: the messages whose offset no range holds."""
    keyed = messages.withColumns({"_p": F.col("partition").cast("int"), "_o": F.col("offset").cast("bigint")})
    known = ranges.select("topic", F.col("partition").alias("_p"), "lo", F.col("hi").alias("_hi"))
    found = asof_join(keyed, known, ["topic", "_p"], "_o", "lo", ["_hi"], by_range(width))
    return found.where(F.col("_hi").isNull() | (F.col("_hi") < F.col("_o"))).select(messages.columns)
