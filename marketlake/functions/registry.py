"""P1 mapped projection + F1 per-column transform registry.

A table mapping says which source fields of a change row are kept, what
they are called in the analytics table, which cleaner (a Column -> Column
function, run natively) types each one, and what a failure means. Users may
register their own cleaners (including a ``pandas_udf``) with
:func:`register_transform`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cleaning as C
from . import dates as D

Transform = Callable[[Column], Column]


@dataclass(frozen=True)
class FieldSpec:
    source: str
    target: str
    dtype: str  # Spark SQL type of the target column
    transform: Transform | None = None  # cleaner; None -> typed cast / date rule
    reject: Transform | None = None  # predicate: True when the value is bad


@dataclass
class TableMapping:
    table: str
    fields: list[FieldSpec] = field(default_factory=list)
    key: tuple[str, ...] = ()  # merge key in the analytics table (W1/U1)
    alt_key: tuple[str, ...] = ()  # natural key used when the (single) key column is null

    @property
    def targets(self) -> list[str]:
        return [f.target for f in self.fields]


# Substrings that mark a source field as a date/time.
DATE_FIELD_MARKERS = ("date", "created", "updated", "joined", "login")


def _is_date_field(name: str) -> bool:
    return any(m in name.lower() for m in DATE_FIELD_MARKERS)


# The six captured tables, their kept fields and target names,
# in the source order. ``product_variants`` is captured but not mapped.
TABLE_MAPPINGS: dict[str, TableMapping] = {
    "users": TableMapping("users", [
        FieldSpec("id", "user_id", "bigint"),
        FieldSpec("age", "user_age", "smallint"),
        FieldSpec("first_name", "first_name", "string"),
        FieldSpec("last_name", "last_name", "string"),
        FieldSpec("is_verified_email", "is_verified_email", "boolean"),
        FieldSpec("is_active", "is_active", "boolean"),
        FieldSpec("date_joined", "date_joined", "timestamp"),
        FieldSpec("last_login", "last_login", "timestamp"),
    ], key=("user_id",)),
    "sellers": TableMapping("sellers", [
        FieldSpec("id", "seller_id", "bigint"),
        FieldSpec("first_name", "first_name", "string"),
        FieldSpec("last_name", "last_name", "string"),
    ], key=("seller_id",)),
    "products": TableMapping("products", [
        FieldSpec("id", "product_id", "bigint"),
        FieldSpec("product_name", "product_name", "string"),
        FieldSpec("main_category", "main_category", "string"),
        FieldSpec("sub_category", "sub_category", "string"),
        FieldSpec("external_ratings", "external_ratings", "float",
                  lambda c: C.rating_default(c).cast("float"), C.rating_reject),
        FieldSpec("external_ratings_count", "external_ratings_count", "bigint",
                  lambda c: C.rating_count_default(c).cast("bigint"), C.rating_count_reject),
        FieldSpec("external_price", "external_price", "decimal(10,2)",
                  C.clean_money_digits, C.clean_money_digits_reject),
    ], key=("product_id",)),
    "order_items": TableMapping("order_items", [
        FieldSpec("id", "order_item_id", "bigint"),
        FieldSpec("order_id", "order_id", "bigint"),
        FieldSpec("product_id", "product_id", "bigint"),
        FieldSpec("seller_id", "seller_id", "bigint"),
        FieldSpec("quantity", "quantity", "bigint"),
    ], key=("order_item_id",), alt_key=("order_id", "product_id", "seller_id")),
    "payments": TableMapping("payments", [
        FieldSpec("id", "payment_id", "bigint"),
        FieldSpec("order_id", "order_id", "bigint"),
        FieldSpec("amount", "amount", "decimal(10,2)", C.money_from_connector, C.money_from_connector_reject),
        FieldSpec("currency", "currency", "string", C.normalize_currency),
        FieldSpec("status", "status", "string"),
        FieldSpec("payment_method", "payment_method", "string"),
        FieldSpec("created_at", "created_at", "timestamp"),
    ], key=("payment_id",), alt_key=("order_id",)),
    "orders": TableMapping("orders", [
        FieldSpec("id", "order_id", "bigint"),
        FieldSpec("user_id", "user_id", "bigint"),
        FieldSpec("status", "status", "string"),
        FieldSpec("created_at", "order_date", "date", D.iso_to_date, D.iso_reject),
    ], key=("order_id", "order_date")),  # the analytics table's sort key: date filters push below W1
}

# B1/B2 compatibility: the reference's own merge keys for the two tables it
# collapses (one item / one payment per order).
COMPAT_KEYS = {"order_items": ("order_id",), "payments": ("order_id",)}

_CUSTOM: dict[tuple[str, str], FieldSpec] = {}


def register_transform(table: str, source: str, transform: Transform,
                       reject: Transform | None = None, dtype: str | None = None) -> None:
    """replace/add the cleaner of ``table.source``."""
    spec = next(f for f in TABLE_MAPPINGS[table].fields if f.source == source)
    _CUSTOM[(table, source)] = FieldSpec(spec.source, spec.target, dtype or spec.dtype, transform, reject)


# Source NUMERIC columns among the mapped fields, with their scale.
NUMERIC_SOURCE_FIELDS = {("payments", "amount"): 2}


def use_plain_decimals() -> None:
    """For a connector that sends NUMERIC as text: clean every value with N1 and decode none.

    By default the mapped NUMERIC fields decode the connector's base64 (N23).
    """
    for table, source in NUMERIC_SOURCE_FIELDS:
        register_transform(table, source, C.clean_money_digits, C.clean_money_digits_reject)


def reset_transforms() -> None:
    _CUSTOM.clear()


def _spec(table: str, f: FieldSpec) -> FieldSpec:
    return _CUSTOM.get((table, f.source), f)


def _typed(f: FieldSpec, raw: Column) -> tuple[Column, Column | None]:
    """Typed value and reject predicate for one field of a change row."""
    if f.transform is not None:
        return f.transform(raw).cast(f.dtype), (f.reject(raw) if f.reject else None)
    if f.dtype in ("timestamp", "date") and _is_date_field(f.source):
        # A bad date string drops the field (null) but keeps the row
        v = D.iso_to_timestamp(raw)
        return (v if f.dtype == "timestamp" else F.to_date(v)), None
    if f.dtype == "string":
        return raw, None
    if f.dtype == "boolean":
        v = F.lower(F.trim(raw)).try_cast("boolean")
    else:
        v = F.trim(raw).try_cast(f.dtype)
    return v, raw.isNotNull() & v.isNull()


def project(after: Column, table: str) -> tuple[list[Column], Column]:
    """Columns of the analytics row and the first-failing reject reason."""
    cols, reason = [], None
    for f in TABLE_MAPPINGS[table].fields:
        f = _spec(table, f)
        raw = after.getItem(f.source)
        v, bad = _typed(f, raw)
        cols.append(v.alias(f.target))
        if bad is not None:
            msg = F.lit(f"bad {f.source}")
            reason = F.when(bad, msg) if reason is None else reason.when(bad, msg)
    return cols, (reason.otherwise(F.lit(None).cast("string")) if reason is not None
                  else F.lit(None).cast("string"))
