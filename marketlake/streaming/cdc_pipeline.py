"""Structured Streaming CDC job.

    messages (Kafka or JSON files)
      -> foreachBatch(batch, batch_id):
           replay guard   R2  drop offsets seen in this batch / in the ledger
           decode+route   P4/N21/N22 (per message, JVM side)
           per table      P1/F1 clean + type, P3 stamp, R3 split rejects
           write          S4 table logs, S14 quarantine, counters, S11 ledger
           refresh        R6 month roll-ups by signed deltas, R4 live reports

Exactly-once effect without a transactional sink: every write of a batch
goes to ``.../batch_id=N`` with overwrite, so when Spark re-runs a batch
after a failure (same id, same offsets from the checkpoint) it replaces its
own output instead of appending twice; the ledger anti-join drops messages
re-delivered under a new batch id. The checkpoint and the output live in the
shared folders given by the caller (never a machine-local path on a cluster).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import registry as REG
from ..operators import cdc as CDC
from ..operators import ledger as L
from ..plans import reports as R  # noqa: F401  (the reports a job may refresh)
from ..sources.files import newest_version, read_table, remove_path, write_batch
from ..sources.versioned_star import VersionedStar, newest_snapshot
from .month_rollups import MonthRollups

# Snapshot layout: orders by day, so report time windows prune partitions.
SNAPSHOT_PARTITIONS = {"orders": ("order_date",)}

class CdcJob:
    """The per-micro-batch work of the CDC stream (usable in batch too)."""

    def __init__(self, out_dir: str, tables=None, etl_ts: Column | None = None,
                 reports: dict[str, Callable] | None = None, as_of=None, rollups: bool = False,
                 apply_deletes: bool = False, compact_every: int | None = None, bucketed: bool = False,
                 ledger_ranges: bool = False):
        self.out = out_dir.rstrip("/")
        self.tables = list(tables or REG.TABLE_MAPPINGS.keys())
        self.etl_ts = etl_ts
        self.reports = reports or {}
        self.as_of = as_of
        self.rollups = rollups
        self.apply_deletes = apply_deletes
        self.compact_every = compact_every
        self.bucketed = bucketed  # snapshots in key buckets, of which a compaction rewrites the changed ones
        self.ledger_ranges = ledger_ranges  # the ledger as disjoint offset ranges, not a row a message

    # paths
    def table_path(self, t: str) -> str:
        return f"{self.out}/tables/{t}"

    @property
    def ledger_path(self) -> str:
        return f"{self.out}/ledger"

    def _seen(self, spark: SparkSession, msgs: DataFrame, batch_id: int) -> DataFrame:
        """Ledger rows in the offset range of this batch (other batch ids only).

        The batch's offset bounds, one row per topic partition, join the ledger
        (Spark broadcasts them while they are small), so only ledger rows inside
        the ranges reach the anti-join.
        """
        ledger = read_table(spark, self.ledger_path, schemas.LEDGER + ", batch_id bigint")
        ledger = ledger.filter(F.col("batch_id") != F.lit(batch_id))
        bounds = msgs.groupBy("topic", "partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
        return ledger.join(bounds, ["topic", "partition"]).where(
            F.col("offset").between(F.col("lo"), F.col("hi")))

    @property
    def ranges_path(self) -> str:
        return f"{self.out}/ledger_ranges"

    def known_ranges(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The offset ranges processed before this batch."""
        known = newest_version(spark, self.ranges_path, "upto=", batch_id)
        if known is None:
            return schemas.empty(spark, L.RANGES)
        return read_table(spark, f"{self.ranges_path}/upto={known}", L.RANGES)

    def extend_ranges(self, spark: SparkSession, new: DataFrame, batch_id: int) -> None:
        """The ranges after this batch: as many rows as the history has gaps. The last two states are kept."""
        ranges = L.merged(self.known_ranges(spark, batch_id).unionByName(L.intervals(new)))
        ranges.coalesce(1).write.mode("overwrite").parquet(f"{self.ranges_path}/upto={batch_id}")
        last = newest_version(spark, self.ranges_path, "upto=", batch_id)
        while last is not None and (old := newest_version(spark, self.ranges_path, "upto=", last)) is not None:
            remove_path(spark, f"{self.ranges_path}/upto={old}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        msgs = CDC.dedup_replays(batch.select("topic", "partition", "offset", "value")).persist()
        if self.ledger_ranges:
            new = L.unprocessed(msgs, self.known_ranges(spark, batch_id)).persist()
        else:
            new = CDC.unseen(msgs, self._seen(spark, msgs, batch_id)).persist()
        decoded = CDC.decode(new, self.tables).persist()
        try:
            etl = self.etl_ts if self.etl_ts is not None else F.lit(dt.datetime.now(dt.timezone.utc).replace(
                tzinfo=None).isoformat(sep=" ")).cast("timestamp")
            for t in self.tables:
                good, bad = CDC.split_rejects(CDC.to_table(decoded, t, etl))
                good = good.withColumn("_deleted", F.lit(False))
                if self.apply_deletes:  # B6: tombstones instead of ignoring deletes
                    good = good.unionByName(CDC.to_tombstones(decoded, t, etl), allowMissingColumns=True)
                write_batch(good, self.table_path(t), batch_id)
                write_batch(bad, f"{self.out}/quarantine/{t}", batch_id)
            write_batch(CDC.dead_letters(decoded), f"{self.out}/quarantine/_messages", batch_id)
            write_batch(CDC.status_counts(decoded), f"{self.out}/metrics", batch_id)
            # the ledger is written last: a batch that fails earlier is redone whole
            if self.ledger_ranges:
                self.extend_ranges(spark, new, batch_id)
            else:
                write_batch(CDC.ledger_rows(new, etl), self.ledger_path, batch_id)
            if self.rollups:  # before compaction, which a run-again of this batch may already find done
                self.update_rollups(spark, batch_id)
            if self.compact_every and (batch_id + 1) % self.compact_every == 0:
                self.compact(spark, batch_id)
            if self.reports:
                self.refresh_reports(spark)
        finally:
            decoded.unpersist()
            new.unpersist()
            msgs.unpersist()

    # R5 --------------------------------------------------------------------
    def versioned(self, spark: SparkSession) -> VersionedStar:
        return VersionedStar(spark, f"{self.out}/tables", snapshots_dir=f"{self.out}/snapshots")

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Incremental compaction - newest snapshot + log batches up to
        ``batch_id`` -> latest row per key, written to ``upto=batch_id``.

        Reads only the previous snapshot and the batches after it; written to a
        new folder (readers switch once ``_SUCCESS`` exists), so a failure mid-
        way leaves the previous snapshot in use.
        """
        star = self.versioned(spark)
        for t in self.tables if self.bucketed else ():
            star.merge_buckets(t, batch_id)
        for t in () if self.bucketed else self.tables:
            prev = newest_snapshot(spark, f"{self.out}/snapshots/{t}")
            if prev is not None and prev >= batch_id:
                continue
            rows = star.latest_rows(t, upto_batch=batch_id)
            w = rows.write.mode("overwrite")
            if t in SNAPSHOT_PARTITIONS:  # report date filters prune these directories
                w = w.partitionBy(*SNAPSHOT_PARTITIONS[t])
            w.parquet(f"{self.out}/snapshots/{t}/upto={batch_id}")
        if self.rollups:
            self.month_rollups(spark).compact(batch_id)

    # R4 --------------------------------------------------------------------
    def refresh_reports(self, spark: SparkSession) -> None:
        star = self.versioned(spark)
        for name, fn in self.reports.items():
            fn(star, as_of=self.as_of).write.mode("overwrite").parquet(f"{self.out}/reports/{name}")

    # R6 --------------------------------------------------------------------
    def month_rollups(self, spark: SparkSession) -> MonthRollups:
        return MonthRollups(spark, self.out, self.versioned(spark), self.as_of)

    def update_rollups(self, spark: SparkSession, batch_id: int) -> None:
        """Bring the month roll-ups up to this batch by signed deltas of the rows it touched."""
        star = self.versioned(spark)
        touched = {t: star.touched(t, batch_id) for t in ("orders", "order_items", "products", "sellers", "users")}
        self.month_rollups(spark).apply(batch_id, touched)


def start(messages: DataFrame, job: CdcJob, checkpoint: str, trigger: dict | None = None,
          query_name: str = "cdc"):
    """Start the stream; ``trigger`` e.g. {"processingTime": "1 second"}
    (the source's poll interval), {"availableNow": True} for a catch-up run, or
    {"processingTime": "30 seconds"} for the dashboard refresh (R4)."""
    w = messages.writeStream.queryName(query_name).foreachBatch(job.process).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
