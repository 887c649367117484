"""Value cleaners (N1-N7, N10, N19, N20, N23, N24) as native Column expressions.

All run inside whole-stage codegen (regexp_replace / translate / try_cast);
none is a Python UDF. Each cleaner that can fail has a companion
``*_reject`` predicate so a loader can route bad rows to quarantine instead
of failing the batch. Digits are ASCII ``[0-9]`` on purpose (Java's ``\\d``
is ASCII, Python's is Unicode); non-ASCII digits are removed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status vocabularies and defaults of the source schema.
PRODUCT_STATUSES = ("active", "archived", "draft")
DEFAULT_PRODUCT_STATUS = "draft"
DEFAULT_CURRENCY = "USD"
DEFAULT_AGE = 21
RUPEE = "₹"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


# N1 -------------------------------------------------------------------------
def clean_money_digits(c, precision: int = 10, scale: int = 2) -> Column:
    """null/'' -> 0; else keep only ``[0-9.]`` and read a decimal.

    The sign and exponent are lost (``-5.00`` -> 5.00, ``1e3`` -> 13), as in
    the source loader. Unparsable leftovers ('', '.', '1.2.3') and overflow
    give null: see :func:`clean_money_digits_reject`.
    """
    c = _c(c).cast("string")
    dec = f"decimal({precision},{scale})"
    digits = F.regexp_replace(c, r"[^0-9.]", "")
    return F.when(_blank(c), F.lit(0).cast(dec)).otherwise(digits.try_cast(dec))


def clean_money_digits_reject(c, precision: int = 10, scale: int = 2) -> Column:
    c = _c(c).cast("string")
    return ~_blank(c) & clean_money_digits(c, precision, scale).isNull()


# N2 -------------------------------------------------------------------------
def _rupee_double(c: Column) -> Column:
    return F.replace(F.replace(F.trim(c), F.lit(RUPEE), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def clean_money_rupee(price, discount) -> tuple[Column, Column]:
    """Strip the rupee sign and thousands commas from both prices.

    If either fails to parse (or is missing), **both** become 0.0.
    Returns ``(price, discount)`` columns.
    """
    p, d = _rupee_double(_c(price)), _rupee_double(_c(discount))
    bad = p.isNull() | d.isNull() | F.isnan(p) | F.isnan(d)
    zero = F.lit(0.0)
    return F.when(bad, zero).otherwise(p), F.when(bad, zero).otherwise(d)


# N3 / N6 --------------------------------------------------------------------
def clean_number_comma_decimal(c) -> Column:
    """Keep digits, '.', ',' and space; drop spaces; ',' -> '.'; double or null."""
    c = _c(c).cast("string")
    kept = F.regexp_replace(c, r"[^0-9., ]", "")
    s = F.translate(F.regexp_replace(kept, " ", ""), ",", ".")
    return F.when(s != "", s.try_cast("double"))


def count_from_float(c) -> Column:
    """int(float(clean or 0)) - truncation toward zero."""
    v = F.coalesce(clean_number_comma_decimal(c), F.lit(0.0))
    return F.when(F.abs(v) < 2147483648.0, v.cast("int"))


# N4 -------------------------------------------------------------------------
def rating_default(c) -> Column:
    """float(x) if x else 0.0."""
    c = _c(c).cast("string")
    return F.when(_blank(c), F.lit(0.0)).otherwise(F.trim(c).try_cast("double"))


def rating_count_default(c) -> Column:
    """int(x) if x else 0."""
    c = _c(c).cast("string")
    return F.when(_blank(c), F.lit(0)).otherwise(F.trim(c).try_cast("int"))


def rating_reject(c) -> Column:
    c = _c(c).cast("string")
    return ~_blank(c) & F.trim(c).try_cast("double").isNull()


def rating_count_reject(c) -> Column:
    c = _c(c).cast("string")
    return ~_blank(c) & F.trim(c).try_cast("int").isNull()


# N5 -------------------------------------------------------------------------
def count_strip_commas(c) -> Column:
    """``"30,227"`` -> 30227; null or unparsable -> null (a reject)."""
    return F.replace(_c(c).cast("string"), F.lit(","), F.lit("")).try_cast("int")


# N7 -------------------------------------------------------------------------
def normalize_currency(c) -> Column:
    """trim + upper; null/'' -> USD; blanks only -> ''."""
    c = _c(c).cast("string")
    return F.when(_blank(c), F.lit(DEFAULT_CURRENCY)).otherwise(F.upper(F.trim(c)))


# N10 / N19 / N20 -------------------------------------------------------------
def default_age(c) -> Column:
    return F.coalesce(_c(c), F.lit(DEFAULT_AGE))


def status_default(c, allowed=PRODUCT_STATUSES, default: str = DEFAULT_PRODUCT_STATUS) -> Column:
    """Outside the vocabulary -> default; absent stays absent."""
    c = _c(c)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c.isin(*allowed), c).otherwise(F.lit(default))


def description_default(c, name=None) -> Column:
    """null description -> '' ; with ``name`` -> 'Description for {name}'."""
    if name is None:
        return F.coalesce(_c(c), F.lit(""))
    return F.coalesce(_c(c), F.concat(F.lit("Description for "), _c(name)))


# N23 ------------------------------------------------------------------------
def connect_decimal(c, scale: int, precision: int = 38) -> Column:
    """Decode a base64 big-endian two's-complement unscaled integer.

    ``AYaf`` scale 2 -> 999.99; ``/w==`` scale 0 -> -1. Values of up to 8 bytes
    (the connector's NUMERIC(10/12, 2) columns); null for a wider one.
    """
    raw = F.unbase64(_c(c))
    nbytes = F.octet_length(raw)
    unsigned = F.conv(F.hex(raw), 16, 10).cast("decimal(38,0)")
    negative = (F.conv(F.substring(F.hex(raw), 1, 1), 16, 10).cast("int") >= 8)
    # two's complement: subtract 2^(8*n) when the top bit is set
    span = F.get(F.array(*[F.lit(Decimal(1 << 8 * n)).cast("decimal(38,0)") for n in range(9)]), nbytes)
    signed = F.when(negative, unsigned - span).otherwise(unsigned)
    value = (signed / F.pow(F.lit(10), F.lit(scale)).cast("decimal(38,0)")).try_cast(f"decimal({precision},{scale})")
    return F.when(nbytes.between(1, 8), value)


# Text shapes of a base64 value (length a multiple of 4) and of a plain number.
BASE64_TEXT = r"^[A-Za-z0-9+/]+={0,2}$"
PLAIN_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"


def money_from_connector(c, scale: int = 2, precision: int = 10) -> Column:
    """Numeric columns arrive base64-encoded under the connector's
    default decimal mode; decode those (N23) and read plain numbers by N1 (e.g.
    a connector configured with string decimals). Null or '' is 0; anything else is
    null, see :func:`money_from_connector_reject`.
    """
    c = _c(c).cast("string")
    plain = _blank(c) | c.rlike(PLAIN_NUMBER)
    is_b64 = c.rlike(BASE64_TEXT) & (F.length(c) % 4 == 0)
    return F.when(plain, clean_money_digits(c, precision, scale)).when(is_b64, connect_decimal(c, scale, precision))


def money_from_connector_reject(c, scale: int = 2, precision: int = 10) -> Column:
    c = _c(c).cast("string")
    return ~_blank(c) & money_from_connector(c, scale, precision).isNull()


# N24 ------------------------------------------------------------------------
def transaction_id(*cols) -> Column:
    """``txn_`` + 32 hex chars, deterministic over the given key columns."""
    key = F.concat_ws("|", *[_c(x).cast("string") for x in cols])
    return F.concat(F.lit("txn_"), F.substring(F.sha2(key, 256), 1, 32))
