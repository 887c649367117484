"""Validity intervals and as-of joins over versioned rows (U1, W1), split along time.

A key's rows are dealt to time buckets, so a key that holds a third of all rows is many
tasks, not one sorted group. What a bucket needs from before (or after) it is one row,
which a window over the key's occupied buckets hands on; the sort-merge inside a
bucket is a window over its own rows. No cross join and no range join is planned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Bucket = Callable[[Column], Column]


def by_days(days: int = 32) -> Bucket:
    """Buckets of a number of days, for date and timestamp columns."""
    return lambda c: F.floor(F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) / F.lit(days))


def by_range(width: int = 1 << 16) -> Bucket:
    """Buckets of ``width`` consecutive numbers."""
    return lambda c: F.floor(c.cast("decimal(20,0)") / F.lit(width)).cast("bigint")


def validity(versions: DataFrame, keys: Sequence[str], time: str, bucket: Bucket | None = None) -> DataFrame:
    """Adds ``valid_to``: the time of the key's next version, null for the newest.

    A version holds from its own time on, up to and without ``valid_to``. Versions of one key and
    time must be reduced to one before.
    """
    keys, bucket = list(keys), bucket or by_days()
    rows = versions.withColumn("_b", bucket(F.col(time)))
    firsts = rows.groupBy(*keys, "_b").agg(F.min(time).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))
    firsts = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"),
                           after.alias("_after"))
    same = F.col("_b") == F.col("_b2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    nxt = F.lead(time).over(Window.partitionBy(*keys, "_b").orderBy(time))
    return rows.join(firsts, same).withColumn("valid_to", F.coalesce(nxt, F.col("_after"))).select(
        *versions.columns, "valid_to")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              cols: Sequence[str], bucket: Bucket | None = None) -> DataFrame:
    """Each left row with ``cols`` of the key's newest right row at or before its time; nulls where there is none.

    ``right`` has one row per key and time. Left rows with a null time or key find nothing.
    """
    keys, cols, bucket = list(keys), list(cols), bucket or by_days()
    l = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_t"),
                    bucket(F.col(left_time)).alias("_b"), F.struct(*left.columns).alias("_l"))
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_t"),
                     bucket(F.col(right_time)).alias("_b"), F.struct(*cols).alias("_r"))
    ks = [f"_k{i}" for i in range(len(keys))]
    nothing = F.lit(None).cast(r.schema["_r"].dataType)
    # per key, over its buckets: the newest right row of the buckets before
    last = r.groupBy(*ks, "_b").agg(F.max_by("_r", "_t").alias("_r"))
    asked = l.select(*ks, "_b").distinct()
    steps = last.select(*ks, "_b", F.lit(False).alias("_ask"), "_r").unionByName(
        asked.select(*ks, "_b", F.lit(True).alias("_ask"), nothing.alias("_r")))
    over = Window.partitionBy(*ks).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_r", F.last("_r", ignorenulls=True).over(over)).where("_ask AND _r IS NOT NULL")
    # inside a bucket: carried row, then right rows before left rows of the same time
    none = F.lit(None).cast(l.schema["_l"].dataType)
    parts = [carried.select(*ks, "_b", F.lit(0).alias("_kind"), F.lit(None).cast(r.schema["_t"].dataType).alias("_t"),
                            "_r", none.alias("_l")),
             r.select(*ks, "_b", F.lit(1).alias("_kind"), "_t", "_r", none.alias("_l")),
             l.select(*ks, "_b", F.lit(2).alias("_kind"), "_t", nothing.alias("_r"), "_l")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    inside = Window.partitionBy(*ks, "_b").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(inside)).where("_kind = 2")
    known = F.col("_t").isNotNull()
    for k in ks:
        known = known & F.col(k).isNotNull()
    return found.select("_l.*", *[F.when(known, F.col("_r")[c]).alias(c) for c in cols])
