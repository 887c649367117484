"""CSV product catalogs (S5, S6, P2, U16) and table sinks.

CSV files are read with an explicit all-string schema (no inference pass over
100 TB) and typed afterwards by the chosen cleaner policy; the file name comes
from the ``_metadata`` column, so the category-from-file-name rule is a
projection, not a Python loop over files.

Sinks write whole DataFrames (one distributed write per batch); writes that
must survive retries are keyed by a batch id and overwrite only their own
folder, so a re-run of the same batch replaces rather than duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cleaning as C

# CSV column -> product column names.
CSV_RENAMES = {
    "name": "product_name",
    "link": "external_link",
    "image": "external_image_url",
    "ratings": "external_ratings",
    "no_of_ratings": "external_ratings_count",
    "actual_price": "external_price",
    "discount_price": "external_discount_price",
}
CLEANER_POLICIES = ("digits", "rupee", "comma_decimal")


def read_csv_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.csv`` under ``path`` as string columns + ``file_name``."""
    df = (
        spark.read.option("header", True).option("multiLine", False)
        .schema(schemas.struct(schemas.CSV_PRODUCT)).csv(path)
    )
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def file_stem_category(file_name: Column) -> Column:
    """The file name's stem before the first dot (``Books.csv`` -> ``Books``)."""
    return F.element_at(F.split(file_name, r"\."), 1)


def rename_csv(df: DataFrame) -> DataFrame:
    """CSV names -> product names."""
    return df.withColumnsRenamed({k: v for k, v in CSV_RENAMES.items() if k in df.columns})


def csv_to_products(df: DataFrame, policy: str = "digits") -> DataFrame:
    """U16: typed product rows from raw CSV rows with one cleaner policy.

    digits        N1 for prices (decimal), N4 ratings, N5 counts (commas dropped)
    rupee         N2 for both prices (double; either failing zeroes both)
    comma_decimal N3 for prices/ratings, N6 for counts (the seeder's policy)
    A ``reject_reason`` column names the first unusable value (or is null).
    """
    if policy not in CLEANER_POLICIES:
        raise ValueError(f"policy must be one of {CLEANER_POLICIES}")
    r = rename_csv(df)
    price, disc = F.col("external_price"), F.col("external_discount_price")
    if policy == "digits":
        out_price, out_disc = C.clean_money_digits(price), C.clean_money_digits(disc)
        rating = C.rating_default(F.col("external_ratings"))
        count = C.count_strip_commas(F.col("external_ratings_count"))
        reason = (
            F.when(C.clean_money_digits_reject(price), "bad external_price")
            .when(C.clean_money_digits_reject(disc), "bad external_discount_price")
            .when(C.rating_reject(F.col("external_ratings")), "bad external_ratings")
            .when(count.isNull(), "bad external_ratings_count")
        )
    elif policy == "rupee":
        out_price, out_disc = C.clean_money_rupee(price, disc)
        rating = C.rating_default(F.col("external_ratings"))
        count = C.count_strip_commas(F.col("external_ratings_count"))
        reason = F.when(count.isNull(), "bad external_ratings_count")
    else:
        out_price = C.clean_number_comma_decimal(price)
        out_disc = C.clean_number_comma_decimal(disc)
        rating = C.clean_number_comma_decimal(F.col("external_ratings"))
        count = C.count_from_float(F.col("external_ratings_count"))
        reason = F.lit(None).cast("string")
    category = F.coalesce(F.col("main_category"), file_stem_category(F.col("file_name"))) \
        if "file_name" in df.columns else F.col("main_category")
    return r.select(
        "product_name",
        C.description_default(F.col("description") if "description" in r.columns else F.lit(None),
                              F.col("product_name")).alias("description"),
        category.alias("main_category"),
        F.col("sub_category"),
        F.col("external_image_url"), F.col("external_link"),
        rating.cast("double").alias("external_ratings"),
        count.cast("int").alias("external_ratings_count"),
        out_price.alias("external_price"), out_disc.alias("external_discount_price"),
        reason.alias("reject_reason"),
    )


# ------------------------------------------------------------------ sinks --
def append_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Append a cleaned DataFrame to a Parquet table in one batch."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent batch append: ``path/batch_id=N`` is replaced on a retry."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={int(batch_id)}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, asked of its own file system; other errors are raised."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete snapshot of a document collection, None before the first."""
    newest = newest_version(spark, path)
    return None if newest is None else spark.read.parquet(f"{path.rstrip('/')}/version={newest}")


def newest_version(spark: SparkSession, path: str, prefix: str = "version=", before: int | None = None) -> int | None:
    """Highest ``<prefix>N`` folder (N under ``before``) that was written to its end (a listing, no scan)."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [int(st.getPath().getName()[len(prefix):]) for st in fs.listStatus(root)
             if st.isDirectory() and st.getPath().getName().startswith(prefix)
             and fs.exists(hadoop.Path(st.getPath(), "_SUCCESS"))]
    return max((n for n in found if before is None or n < before), default=None)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file through its own file system; nothing happens when it is not there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def upsert_documents(docs: DataFrame, path: str, key: str = "id", order=("etl_updated_at",)) -> None:
    """Merge a batch into a collection: one document per key, the latest wins.

    Documents that are not in the batch stay. The merged collection is a new
    ``version=N`` folder, so a failed write leaves the previous one in use.
    """
    from ..operators.versioned import latest_version

    spark = docs.sparkSession
    stored = read_documents(spark, path)
    rows = docs if stored is None else stored.unionByName(docs, allowMissingColumns=True)
    number = 0 if stored is None else newest_version(spark, path) + 1
    latest_version(rows, [key], list(order)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={number}")


def is_empty_table(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    """True when nothing exists at ``path`` or the table there has no rows.

    A target that exists and cannot be read is an error, never "empty".
    """
    return not path_exists(spark, path) or spark.read.format(fmt).load(path).limit(1).isEmpty()


def bootstrap(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Load seed data only when the target is empty; returns True if loaded."""
    if not is_empty_table(spark, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Read a table with its fixed schema; an empty frame only when it was never written."""
    if not path_exists(spark, path):
        return schemas.empty(spark, ddl)
    return spark.read.schema(schemas.struct(ddl)).parquet(path)
