"""Tables clustered along a space-filling curve, so that filters on any of several columns prune files.

Each column is scaled to ``BITS`` bits between its smallest and largest value, and the bits are
interleaved (Z-order). Rows are dealt to files by ranges of that number and sorted inside, so a file
spans a small box in all columns, and the minima and maxima that Parquet keeps rule most files out for a
filter on any one column. One range shuffle; a value that fills a third of the rows is split by the other columns.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 10


def scaled(df: DataFrame, col: str, bits: int = BITS) -> Column:
    """The column's place between its smallest and largest value, as a number of ``bits`` bits; null counts as the smallest."""
    number = F.unix_micros(F.col(col).cast("timestamp")) if isinstance(
        df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(col)
    number = number.cast("double")
    ends = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    share = F.coalesce(F.try_divide(number - lo, hi - lo), F.lit(0.0))
    return F.least(F.floor(share * F.lit(1 << bits)), F.lit((1 << bits) - 1)).cast("bigint")


def z_order(df: DataFrame, cols: Sequence[str], bits: int = BITS) -> Column:
    """The interleaved bits of the scaled columns, the first column's bit highest."""
    if len(cols) * bits > 62:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit a number of 62")
    parts = []
    for i, c in enumerate(cols):
        v = scaled(df, c, bits)
        for b in range(bits):
            parts.append(F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), b * len(cols) + len(cols) - 1 - i))
    return functools.reduce(lambda a, b: a.bitwiseOR(b), parts)


def write_clustered(df: DataFrame, path: str, cols: Sequence[str], files: int, bits: int = BITS) -> None:
    """Write ``df`` in ``files`` ranges of the curve through ``cols``."""
    rows = df.withColumn("_z", z_order(df, cols, bits))
    rows.repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z").write.mode("overwrite").parquet(path)
