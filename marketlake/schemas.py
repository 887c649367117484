"""Fixed table schemas (S13) and the search document schema.

Source (row-store) tables, analytics (versioned) tables, the CDC ledger, the
raw message frame, CSV catalog rows and request frames - all as Spark DDL so
readers never infer types at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source tables (row store), Spark DDL.
SOURCE_TABLES = {
    "users": "id bigint, age int, email string, password string, first_name string, last_name string, "
             "is_verified_email boolean, is_active boolean, is_superuser boolean, role string, "
             "date_joined timestamp, updated_at timestamp, last_login timestamp",
    "users_verifications": "id bigint, user_id bigint, request_type string, new_email string, new_phone string, "
                           "active_access_token string, created_at timestamp, updated_at timestamp",
    "sellers": "id bigint, first_name string, last_name string, user_id bigint, product_ids array<bigint>, "
               "is_active boolean, created_at timestamp",
    "user_activities": "id bigint, user_id bigint, product_id bigint, action string, timestamp timestamp",
    "products": "id bigint, product_name string, description string, status string, main_category string, "
                "sub_category string, external_image_url string, external_link string, external_ratings double, "
                "external_ratings_count int, external_discount_price string, external_price string, "
                "created_at timestamp, updated_at timestamp, published_at timestamp, seller_id bigint",
    "product_options": "id bigint, product_id bigint, option_name string",
    "product_option_items": "id bigint, option_id bigint, item_name string",
    "product_variants": "id bigint, product_id bigint, price decimal(12,2), stock int, option1 bigint, "
                        "option2 bigint, option3 bigint, created_at timestamp, updated_at timestamp",
    "product_media": "id bigint, product_id bigint, alt string, src string, type string, created_at timestamp, "
                     "updated_at timestamp",
    "orders": "id bigint, user_id bigint, status string, total_amount decimal(10,2), created_at timestamp, "
              "updated_at timestamp",
    "order_items": "id bigint, order_id bigint, product_id bigint, variant_id bigint, seller_id bigint, "
                   "quantity int, price decimal(10,2)",
    "payments": "id bigint, order_id bigint, amount decimal(10,2), currency string, status string, "
                "payment_method string, payment_intent_id string, payment_details string, created_at timestamp, "
                "updated_at timestamp",
}

# Analytics tables (versioned by etl_updated_at), Spark DDL.
ANALYTICS_TABLES = {
    "users": "user_id bigint, user_age smallint, first_name string, last_name string, is_verified_email boolean, "
             "is_active boolean, date_joined timestamp, last_login timestamp, etl_updated_at timestamp",
    "sellers": "seller_id bigint, first_name string, last_name string, etl_updated_at timestamp",
    "products": "product_id bigint, product_name string, main_category string, sub_category string, "
                "external_ratings float, external_ratings_count bigint, external_price decimal(10,2), "
                "etl_updated_at timestamp",
    "order_items": "order_item_id bigint, order_id bigint, product_id bigint, seller_id bigint, quantity bigint, "
                   "etl_updated_at timestamp",
    "payments": "payment_id bigint, order_id bigint, amount decimal(10,2), currency string, status string, "
                "payment_method string, created_at timestamp, etl_updated_at timestamp",
    "orders": "order_id bigint, order_date date, user_id bigint, status string, etl_updated_at timestamp",
}

LEDGER = "topic string, partition int, offset bigint, processed_at timestamp"
MESSAGES = "topic string, partition int, offset bigint, value string"
CSV_PRODUCT = ("name string, main_category string, sub_category string, image string, link string, "
               "ratings string, no_of_ratings string, discount_price string, actual_price string, "
               "description string")
ORDER_REQUEST = "request_id bigint, user_id bigint, variant_id bigint, quantity int"
PAYMENT_REQUEST = "order_id bigint, user_id bigint, method string, card_token string"

# The search document mapping (text name/description, keyword category,
# nested attributes).
SEARCH_DOCUMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", T.FloatType()),
    T.StructField("seller_id", T.IntegerType()),
    T.StructField("stock", T.IntegerType()),
    T.StructField("rating", T.FloatType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("attributes", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
])


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Select/cast ``df`` to ``schema`` (missing columns become typed nulls)."""
    st = struct(schema) if isinstance(schema, str) else schema
    cols = []
    for f in st.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def empty(spark, schema: T.StructType | str) -> DataFrame:
    st = struct(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([], st)
