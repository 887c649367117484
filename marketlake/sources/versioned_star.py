"""Star adapter over the versioned analytics tables written by the CDC job.

Each table is an append log (one folder per micro-batch); readers see the
latest version per key (W1), so unmerged versions never double count (B3).
The methods return the same columns as :class:`sources.testdata.Star`, so
every report runs unchanged on the live tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import registry as REG
from ..operators.versioned import latest_version
from .buckets import BucketedTable
from .files import newest_version, read_table

VERSION_ORDER = ["etl_updated_at", "_batch", "_offset"]


def primary_key(table: str) -> str:
    """Target name of the source primary key ``id`` (else the first merge key)."""
    m = REG.TABLE_MAPPINGS[table]
    return next((f.target for f in m.fields if f.source == "id"), m.key[0])


def _log_ddl(table: str) -> str:
    return (schemas.ANALYTICS_TABLES[table]
            + ", _topic string, _partition int, _offset bigint, _deleted boolean, batch_id bigint")


def newest_snapshot(spark: SparkSession, snap_dir: str, most: int | None = None) -> int | None:
    """Highest ``upto=N`` folder (N up to ``most``) under ``snap_dir`` (a file-system listing, no scan)."""
    return newest_version(spark, snap_dir, "upto=", None if most is None else most + 1)


def merge_key(table: str):
    """The column that tells rows of one key: the primary key when the message carried one, else the natural key."""
    m = REG.TABLE_MAPPINGS[table]
    pk = F.col(primary_key(table))
    known = F.concat(F.lit("#"), pk.cast("string"))
    if not m.alt_key:
        return known
    return F.when(pk.isNotNull(), known).otherwise(F.concat_ws("|", *[F.col(c).cast("string") for c in m.alt_key]))


class VersionedStar:
    """Latest-per-key view of the CDC output.

    With ``snapshots_dir`` (written by :meth:`CdcJob.compact`), a table is read
    as its newest compacted snapshot plus only the log batches after it
    (partition-pruned on ``batch_id``), so readers never re-aggregate every
    historical version.
    """

    def __init__(self, spark: SparkSession, tables_dir: str, compat_keys: bool = False,
                 snapshots_dir: str | None = None):
        self.spark = spark
        self.dir = tables_dir.rstrip("/")
        self.compat = compat_keys
        self.snap = snapshots_dir.rstrip("/") if snapshots_dir else None

    def raw_log(self, table: str, after_batch: int | None = None, upto_batch: int | None = None) -> DataFrame:
        log = read_table(self.spark, f"{self.dir}/{table}", _log_ddl(table))
        if after_batch is not None:
            log = log.filter(F.col("batch_id") > F.lit(after_batch))
        if upto_batch is not None:
            log = log.filter(F.col("batch_id") <= F.lit(upto_batch))
        return log.withColumnRenamed("batch_id", "_batch")

    def log(self, table: str) -> DataFrame:
        upto = newest_snapshot(self.spark, f"{self.snap}/{table}") if self.snap else None
        held = self.buckets(table).newest() if self.snap else None
        if held is not None and (upto is None or held >= upto):
            return self._bucketed(table, held).unionByName(self.raw_log(table, after_batch=held))
        if upto is None:
            return self.raw_log(table)
        snap = read_table(self.spark, f"{self.snap}/{table}/upto={upto}",
                          _log_ddl(table).replace(", batch_id bigint", ", _batch bigint"))
        return snap.unionByName(self.raw_log(table, after_batch=upto))

    def buckets(self, table: str) -> BucketedTable:
        """The table's bucketed snapshot; its version is the last batch merged into it."""
        return BucketedTable(self.spark, f"{self.snap}/{table}.buckets", merge_key(table))

    def _bucketed(self, table: str, version: int) -> DataFrame:
        schema = schemas.struct(_log_ddl(table).replace(", batch_id bigint", ", _batch bigint"))
        return self.buckets(table).read(schema, version)

    def merge_buckets(self, table: str, upto_batch: int) -> list[int]:
        """Bring the log up to ``upto_batch`` into the bucketed snapshot; only changed buckets are rewritten."""
        held = self.buckets(table)
        prev = held.newest()
        if prev is not None and prev >= upto_batch:
            return []
        changes = self.raw_log(table, after_batch=prev, upto_batch=upto_batch)
        done = held.merge(changes, lambda stored, new: self._latest(
            new if stored is None else stored.unionByName(new), table), upto_batch)
        held.vacuum()
        return done

    def latest(self, table: str) -> DataFrame:
        return self._latest(self.log(table), table)

    def log_upto(self, table: str, upto_batch: int) -> DataFrame:
        """The newest snapshot up to ``upto_batch`` and the log batches after it."""
        prev = newest_snapshot(self.spark, f"{self.snap}/{table}", upto_batch) if self.snap else None
        held = self.buckets(table).newest(upto_batch + 1) if self.snap else None
        if held is not None and (prev is None or held >= prev):
            return self._bucketed(table, held).unionByName(self.raw_log(table, held, upto_batch))
        log = self.raw_log(table, after_batch=prev, upto_batch=upto_batch)
        if prev is None:
            return log
        snap = read_table(self.spark, f"{self.snap}/{table}/upto={prev}",
                          _log_ddl(table).replace(", batch_id bigint", ", _batch bigint"))
        return snap.unionByName(log)

    def latest_rows(self, table: str, upto_batch: int) -> DataFrame:
        """Latest live row per key over everything up to ``upto_batch`` (for compaction)."""
        return self._latest(self.log_upto(table, upto_batch), table)

    # keys one batch touched, and the live rows of some keys only
    def touched(self, table: str, batch_id: int) -> DataFrame:
        """The keys that batch ``batch_id`` changed or deleted: ``_key`` and the primary key."""
        log = self.raw_log(table, after_batch=batch_id - 1, upto_batch=batch_id)
        return log.select(merge_key(table).alias("_key"), primary_key(table)).distinct()

    def live_of(self, table: str, keys: DataFrame, upto_batch: int) -> DataFrame:
        """The live rows after ``upto_batch`` whose key is in ``keys`` (``_key``)."""
        log = self.log_upto(table, upto_batch).withColumn("_key", merge_key(table))
        return self._latest(log.join(keys.select("_key").distinct(), "_key", "left_semi").drop("_key"), table)

    def orders_of(self, order_ids: DataFrame, upto_batch: int) -> DataFrame:
        """The live orders of the given ids."""
        return self.live_of("orders", order_ids.select(merge_key("orders").alias("_key")), upto_batch)

    def items_of_orders(self, order_ids: DataFrame, upto_batch: int) -> DataFrame:
        """The live items of the given orders; an item that has since moved away is not among them."""
        ids = order_ids.select("order_id").distinct()
        once = self.log_upto("order_items", upto_batch).join(ids, "order_id", "left_semi")
        live = self.live_of("order_items", once.select(merge_key("order_items").alias("_key")), upto_batch)
        return live.join(ids, "order_id", "left_semi")

    def _latest(self, log: DataFrame, table: str) -> DataFrame:
        m = REG.TABLE_MAPPINGS[table]
        if self.compat and table in REG.COMPAT_KEYS:
            keys = list(REG.COMPAT_KEYS[table])
        elif m.alt_key:
            log = log.withColumn("_merge_key", merge_key(table))
            keys = ["_merge_key"]
        else:
            keys = list(m.key)
        deleted = F.coalesce(F.col("_deleted"), F.lit(False))
        latest = latest_version(log.filter(~deleted), keys, VERSION_ORDER)
        # B6 apply_deletes: a tombstone carries only the source primary key; it
        # removes every version of that key that is older than the tombstone
        pk = primary_key(table)
        version = F.struct(*[F.col(c) for c in VERSION_ORDER])
        tombs = log.filter(deleted).groupBy(pk).agg(F.max(version).alias("_tomb"))
        out = latest.join(tombs, pk, "left").filter(
            F.col("_tomb").isNull() | (version > F.col("_tomb"))).drop("_tomb")
        return out.drop("_merge_key") if "_merge_key" in out.columns else out

    def orders(self) -> DataFrame:
        return self.latest("orders").select("order_id", "order_date", "user_id", "status")

    def order_items(self) -> DataFrame:
        return self.latest("order_items").select(
            "order_id", "product_id", "seller_id", F.col("quantity").cast("int").alias("quantity"))

    def products(self) -> DataFrame:
        return self.latest("products").select(
            "product_id", "product_name", "main_category", "sub_category", "external_price")

    def sellers(self) -> DataFrame:
        return self.latest("sellers").select("seller_id", "first_name", "last_name")

    def users(self, activity: bool = False) -> DataFrame:
        u = self.latest("users").select(
            "user_id", F.col("user_age").cast("int").alias("user_age"), "first_name", "last_name",
            "date_joined", "last_login")
        return u if activity else u.drop("date_joined", "last_login")

    def payments(self) -> DataFrame:
        return self.latest("payments")
