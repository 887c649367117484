"""Tables in key-hash buckets, of which a merge rewrites only those that changed.

Layout: ``data/version=N/_bucket=K/*.parquet`` holds the buckets that version N rewrote, and
``manifest/version=N`` names for every bucket the version that holds it. A merge writes the new
buckets first and the manifest last (complete once its ``_SUCCESS`` exists), so readers switch from
one whole state to the next, and a run that fails leaves the old manifest in force. ``vacuum``
removes bucket folders that none of the kept manifests names.

The driver handles one number a bucket, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import newest_version, path_exists, remove_path

MANIFEST = "bucket int, version bigint"
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


class BucketedTable:
    """A bucketed table under ``path``; ``key`` is the column that rows of one key share."""

    def __init__(self, spark: SparkSession, path: str, key: Column, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def newest(self, before: int | None = None) -> int | None:
        return newest_version(self.spark, f"{self.path}/manifest", "version=", before)

    def manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, schema: StructType, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table's state (of some buckets only, if given); None before the first merge."""
        version = self.newest() if version is None else version
        if version is None:
            return None
        held = {b: v for b, v in self.manifest(version).items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._folder(b, v) for b, v in sorted(held.items())])

    def merge(self, changes: DataFrame, combine: Merge, version: int | None = None) -> list[int]:
        """Bring ``changes`` in; returns the buckets that were rewritten.

        ``combine`` gets the stored rows of the changed buckets (None at first) and the changes, and
        gives the rows to store. A version that is merged again replaces its own unfinished data.
        """
        version = (-1 if self.newest() is None else self.newest()) + 1 if version is None else version
        before = self.newest(version)
        held = {} if before is None else self.manifest(before)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        changes = changes.persist()
        try:
            touched = sorted(r["b"] for r in changes.select(bucket.alias("b")).distinct().collect())
            stored = None if before is None else self.read(changes.schema, before, touched)
            data = f"{self.path}/data/version={version}"
            rows = combine(stored, changes).withColumn("_bucket", bucket)
            rows.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        finally:
            changes.unpersist()
        held = {b: v for b, v in held.items() if b not in touched}
        held |= {b: version for b in touched if path_exists(self.spark, self._folder(b, version))}
        named = self.spark.createDataFrame(sorted(held.items()), MANIFEST)
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the newest ``keep`` manifests, and the bucket folders none of these names."""
        kept, at = [], None
        while len(kept) < keep and (at := self.newest(at)) is not None:
            kept.append(at)
        if not kept:
            return []
        named = {self._folder(b, v) for k in kept for b, v in self.manifest(k).items()}
        while (old := self.newest(kept[-1])) is not None:
            remove_path(self.spark, f"{self.path}/manifest/version={old}")
        gone = []
        for version in range(kept[0] + 1):
            for b in range(self.buckets) if path_exists(self.spark, f"{self.path}/data/version={version}") else ():
                if self._folder(b, version) not in named and path_exists(self.spark, self._folder(b, version)):
                    remove_path(self.spark, self._folder(b, version))
                    gone.append(self._folder(b, version))
        return gone

    def _folder(self, bucket: int, version: int) -> str:
        return f"{self.path}/data/version={version}/_bucket={bucket}"


def upsert_document_buckets(docs: DataFrame, path: str, key: str = "id", order=("etl_updated_at",),
                            buckets: int = 64) -> list[int]:
    """One document per key, the latest wins; only the buckets of the batch's documents are rewritten."""
    from ..operators.versioned import latest_version

    def combine(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if stored is None else stored.unionByName(batch)
        return latest_version(rows, [key], list(order))

    table = BucketedTable(docs.sparkSession, path, F.col(key).cast("string"), buckets)
    touched = table.merge(docs, combine)
    table.vacuum()
    return touched


def read_document_buckets(spark: SparkSession, path: str, schema: StructType, key: str = "id",
                          buckets: int = 64) -> DataFrame | None:
    """The stored collection; None before the first batch."""
    return BucketedTable(spark, path, F.col(key).cast("string"), buckets).read(schema)
