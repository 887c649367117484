"""Change-message sources (S1 cdc_source, S2 topic set, S3 micro-batch size).

Both readers return the same streaming frame ``(topic, partition, offset,
value)``:

* Kafka: ``subscribePattern`` on the capture topics (new topics are picked up
  by the consumer's metadata refresh, which replaces the source's periodic
  re-subscribe), earliest offsets, ``maxOffsetsPerTrigger`` for the batch
  size. The Kafka connector jar must be on the cluster's classpath.
* JSON files: one message per line, for tests and replays; the topic filter
  keeps the mapped tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import registry as REG
from ..functions import text as TX

# The source consumer's batch size and poll interval (for runs that mirror it).
SOURCE_BATCH_SIZE = 100
POLL_INTERVAL = "1 second"


def kafka_options(bootstrap: str, max_per_trigger: int | None = None,
                  pattern: str = TX.TOPIC_SUBSCRIBE_PATTERN, accept_lost_offsets: bool = False) -> dict[str, str]:
    """Reader options of the capture-topic subscription.

    A batch takes what has arrived unless ``max_per_trigger`` bounds it. Offsets
    that the broker has aged out stop the stream; ``accept_lost_offsets`` is the
    explicit way to go on without them.
    """
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribePattern": pattern,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false" if accept_lost_offsets else "true",
    }
    if max_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def kafka_messages(spark: SparkSession, bootstrap: str, max_per_trigger: int | None = None,
                   accept_lost_offsets: bool = False) -> DataFrame:
    """Streaming messages from Kafka (needs the Kafka connector)."""
    r = spark.readStream.format("kafka")
    for k, v in kafka_options(bootstrap, max_per_trigger, accept_lost_offsets=accept_lost_offsets).items():
        r = r.option(k, v)
    return r.load().select(
        "topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("bigint").alias("offset"),
        F.col("value").cast("string").alias("value"),
    )


def file_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 (file form): JSON lines with topic, partition, offset, value."""
    r = spark.readStream.schema(schemas.struct(schemas.MESSAGES))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def topic_filter(messages: DataFrame, tables=None) -> DataFrame:
    """Keep only messages of the capture topics whose table is mapped."""
    mapped = list(tables or REG.TABLE_MAPPINGS.keys())
    return messages.filter(TX.topic_table(F.col("topic")).isin(*mapped))


def new_topics(expected: DataFrame, existing: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Expected intersect existing, minus already subscribed (one ``topic`` column)."""
    return expected.select("topic").intersect(existing.select("topic")).subtract(subscribed.select("topic"))


def dedup_within_watermark(messages: DataFrame, event_time: str = "timestamp", delay: str = "1 hour") -> DataFrame:
    """R2 (streaming state): drop re-delivered (topic, partition, offset) keys
    seen within ``delay`` of event time; state stays bounded by the watermark.
    Kafka frames carry ``timestamp``; file frames need an event-time column.
    """
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(
        ["topic", "partition", "offset"])
