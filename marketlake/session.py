"""Spark session defaults for the marketplace engine.

Queries never depend on these settings for correctness (timestamps in the
inputs are ``timestamp_ntz`` and every report compares typed literals), but
the settings below are what the plans are designed around:

* AQE re-plans joins at runtime from real shuffle sizes: a dimension that
  turns out small after filtering becomes a broadcast, a partition that holds
  a hot key is split (skew join), tiny shuffle partitions are coalesced.
* The runtime bloom filter lets a selective ``orders`` filter prune the
  ``order_items`` side before it is shuffled.
* ``spark.checkpoint.dir`` is read from the cluster; only a local master, whose
  tasks share the driver's disk, gets a scratch folder when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on for its plan shape (not for its results).
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "marketlake",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's plan settings.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        # local runs: no web UI, driver holds all memory
        b = b.config("spark.ui.enabled", "false")
    for k, v in PLAN_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/object store)
    folder and is left alone; without it, only a local master gets a scratch
    folder, any other is an error, for executors could not share the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="marketlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def durable_cut(df, spark: SparkSession | None = None):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint, whose blocks live on
    the executors that computed them).
    """
    ensure_checkpoint_dir(spark or df.sparkSession)
    return df.checkpoint(eager=True)


def stored_cut(df):
    """As :func:`durable_cut`, in Parquet: for large frames of which later steps read a few columns each."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
