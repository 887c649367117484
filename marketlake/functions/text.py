"""String helpers (N13, N16, N18, N21, N22, N25, N26) as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Change-topic naming of the capture connector.
TOPIC_PREFIX = "postgres.public."
TOPIC_REGEX = r"^postgres\.public\.(\w+)"
TOPIC_SUBSCRIBE_PATTERN = r"postgres\.public\.\w+"
# Fixed value: where product media files are served from.
MEDIA_PATH = "media/products"

# The change envelope. ``before``/``after`` are read as string maps so
# every column arrives as its JSON text and each table's cleaners type it.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("before", T.MapType(T.StringType(), T.StringType())),
        T.StructField("after", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_ms", T.LongType()),
    ]
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_name(first, last) -> Column:
    """First + ' ' + last (nulls skipped, like concat_ws)."""
    return F.concat_ws(" ", _c(first), _c(last))


def media_url(base: str, product_id, file_name) -> Column:
    """{base}/media/products/{product}/{file}; null file -> null."""
    return F.concat(
        F.lit(base.rstrip("/") + "/" + MEDIA_PATH + "/"), _c(product_id).cast("string"), F.lit("/"), _c(file_name)
    )


def variant_label(price) -> Column:
    """N18: '{price} USD'."""
    return F.concat(_c(price).cast("string"), F.lit(" USD"))


def topic_table(topic) -> Column:
    """Table name from ``postgres.public.<table>``; '' when no match."""
    return F.regexp_extract(_c(topic), TOPIC_REGEX, 1)


def parse_envelope(value) -> Column:
    """JSON text -> struct(op, before, after, ts_ms); malformed -> null."""
    return F.from_json(_c(value).cast("string"), ENVELOPE_SCHEMA, {"mode": "PERMISSIVE"})


def page_offset(page, limit) -> Column:
    """(page - 1) * limit."""
    return (_c(page) - 1) * _c(limit)


def page_count(total, limit) -> Column:
    """ceil(total / limit) in integer arithmetic."""
    return F.floor((_c(total) + _c(limit) - 1) / _c(limit)).cast("bigint")


def conditional_value(pred: Column, value) -> Column:
    """CASE WHEN pred THEN value END (null otherwise)."""
    return F.when(pred, _c(value))
