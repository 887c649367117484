"""Change-data-capture batch operators.

Input: a DataFrame of raw messages ``(topic, partition, offset, value)`` - a
Kafka source, a JSON file stream, or a frame derived from snapshot tables.
Every step is a projection/filter on that frame (no per-message Python):

    decode   -> table from topic (N21), envelope from JSON (N22), status
    route    -> ops r/c/u with a non-empty ``after`` (P4)
    to_table -> mapped, cleaned, typed analytics rows + reject reason (P1, F1)
    split    -> good rows and quarantined rows (S14, R3)
    unseen   -> drop messages already in the ledger (J12, R2)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry as REG
from ..functions import text as TX

# The change operations that carry a row image to load.
LOAD_OPS = ("r", "c", "u")
DELETE_OP = "d"


def decode(messages: DataFrame, tables=None) -> DataFrame:
    """Add ``table_name``, ``op``, ``after``, ``before`` and a ``status``.

    status: ok | delete | empty | unknown_op | bad_json | unmapped | unknown_topic
    """
    mapped = list(tables or REG.TABLE_MAPPINGS.keys())
    env = TX.parse_envelope(F.col("value"))
    # The parsed envelope is produced by a generator (one row in, one out):
    # filters on its fields cannot be pushed below it, so the JSON is parsed
    # exactly once per message, after any repartitioning - instead of being
    # inlined into every predicate that reads op/after.
    d = messages.select(
        "topic", "partition", "offset", "value",
        TX.topic_table(F.col("topic")).alias("table_name"),
        F.explode(F.array(env)).alias("_env"),
    )
    op = F.col("_env.op")
    after = F.col("_env.after")
    status = (
        F.when(F.col("table_name") == "", "unknown_topic")
        .when(~F.col("table_name").isin(*mapped), "unmapped")
        .when(F.col("_env").isNull() | op.isNull(), "bad_json")
        .when(op == DELETE_OP, "delete")
        .when(op.isin(*LOAD_OPS) & (after.isNull() | (F.size(after) <= 0)), "empty")
        .when(op.isin(*LOAD_OPS), "ok")
        .otherwise("unknown_op")
    )
    return d.select(
        "topic", "partition", "offset", "value", "table_name",
        op.alias("op"), after.alias("after"), F.col("_env.before").alias("before"),
        status.alias("status"),
    )


def route(decoded: DataFrame, table: str | None = None) -> DataFrame:
    """Keep loadable row images (ops r/c/u with a non-empty ``after``)."""
    r = decoded.filter(F.col("status") == "ok")
    return r.filter(F.col("table_name") == table) if table else r


def to_table(decoded: DataFrame, table: str, etl_ts: Column | None = None) -> DataFrame:
    """P1 + P3: mapped, cleaned, typed rows of ``table`` with lineage.

    Adds ``etl_updated_at`` (injectable for tests), ``_topic``,
    ``_partition``, ``_offset`` and ``reject_reason`` (null when the row is good).
    """
    cols, reason = REG.project(F.col("after"), table)
    etl = etl_ts if etl_ts is not None else F.current_timestamp()
    return route(decoded, table).select(
        *cols,
        etl.alias("etl_updated_at"),
        F.col("topic").alias("_topic"),
        F.col("partition").alias("_partition"),
        F.col("offset").alias("_offset"),
        reason.alias("reject_reason"),
    )


def to_tombstones(decoded: DataFrame, table: str, etl_ts: Column | None = None) -> DataFrame:
    """B6 option: delete messages of ``table`` as tombstone rows.

    The key columns come from the ``before`` image; every other column is
    null and ``_deleted`` is true, so the latest-version view drops the key.
    """
    mapping = REG.TABLE_MAPPINGS[table]
    cols, _ = REG.project(F.col("before"), table)
    keep = [c for c, f in zip(cols, mapping.fields) if f.target in mapping.key]
    etl = etl_ts if etl_ts is not None else F.current_timestamp()
    d = decoded.filter((F.col("status") == "delete") & (F.col("table_name") == table) & F.col("before").isNotNull())
    return d.select(
        *keep, etl.alias("etl_updated_at"), F.col("topic").alias("_topic"),
        F.col("partition").alias("_partition"), F.col("offset").alias("_offset"),
        F.lit(True).alias("_deleted"),
    )


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason column, rejected rows)."""
    good = rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = rows.filter(F.col("reject_reason").isNotNull())
    return good, bad


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Messages that could not be decoded, kept with their reason."""
    return decoded.filter(F.col("status").isin("bad_json", "unknown_op")).select(
        "topic", "partition", "offset", "value", F.col("status").alias("reject_reason")
    )


def status_counts(decoded: DataFrame) -> DataFrame:
    """Counters of routed / ignored / failed messages per table and status."""
    return decoded.groupBy("table_name", "status").agg(F.count(F.lit(1)).alias("messages"))


def unseen(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages whose (topic, partition, offset) is not in the ledger."""
    keys = ["topic", "partition", "offset"]
    return messages.join(ledger.select(*keys), keys, "left_anti")


def ledger_rows(messages: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Ledger entries for a batch of processed messages."""
    return messages.select(
        "topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("bigint").alias("offset"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"),
    )


def dedup_replays(messages: DataFrame) -> DataFrame:
    """R2 inside one batch: one message per (topic, partition, offset)."""
    return messages.dropDuplicates(["topic", "partition", "offset"])
