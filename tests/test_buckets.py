"""Bucketed snapshots and the range ledger, alone and in the change stream."""
import json

import pytest
from pyspark.sql import functions as F

from marketlake.sources import buckets as B
from marketlake.streaming import cdc_pipeline as P

MESSAGE = "topic string, partition int, offset long, value string"
ROW = "id long, name string, etl_updated_at long"


def combine(stored, new):
    rows = new if stored is None else stored.unionByName(new)
    return rows.groupBy("id").agg(F.max_by("name", "etl_updated_at").alias("name"), F.max("etl_updated_at").alias("etl_updated_at"))


def state(table, schema):
    return sorted((r.id, r.name) for r in table.read(schema).collect())


def test_only_changed_buckets_are_written(spark, scratch):
    first = spark.createDataFrame([(i, f"a{i}", 1) for i in range(200)], ROW)
    table = B.BucketedTable(spark, f"{scratch}/t", F.col("id"), 16)
    assert table.read(first.schema) is None
    assert len(table.merge(first, combine)) == 16
    one = spark.createDataFrame([(7, "b7", 2), (7, "old", 0)], ROW)
    touched = table.merge(one, combine)
    assert len(touched) == 1 and set(table.manifest(1).values()) == {0, 1}
    assert state(table, first.schema) == [(i, "b7" if i == 7 else f"a{i}") for i in range(200)]
    # a run that fails after its data leaves the old manifest in force, and may be run again
    def fails(stored, new):
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([(8, "c8", 3)], ROW), fails)
    combine(None, one).withColumn("_bucket", F.lit(3)).write.partitionBy("_bucket").parquet(f"{scratch}/t/data/version=2")
    assert table.newest() == 1 and state(table, first.schema)[7] == (7, "b7")
    table.merge(spark.createDataFrame([(8, "c8", 3)], ROW), combine)
    assert state(table, first.schema)[7:9] == [(7, "b7"), (8, "c8")]
    # emptied buckets leave the manifest; folders nobody names are removed
    table.merge(spark.createDataFrame([(8, None, 9)], ROW), lambda s, n: s.limit(0))
    assert len(table.manifest(3)) == 15
    gone = table.vacuum(keep=1)
    assert gone and len(state(table, first.schema)) < 200 and table.newest(3) is None


def test_document_upserts(spark, scratch):
    docs = lambda rows: spark.createDataFrame(rows, ROW)
    B.upsert_document_buckets(docs([(1, "a", 1), (2, "b", 1)]), f"{scratch}/d", buckets=8)
    touched = B.upsert_document_buckets(docs([(2, "c", 2), (2, "late", 0)]), f"{scratch}/d", buckets=8)
    got = B.read_document_buckets(spark, f"{scratch}/d", docs([(1, "", 1)]).schema, buckets=8)
    assert len(touched) == 1 and sorted((r.id, r.name) for r in got.collect()) == [(1, "a"), (2, "c")]


def test_stream_with_buckets_and_ranges(spark, scratch):
    o = "postgres.public.orders"

    def order(at, i, status, op="u"):
        row = {"id": i, "user_id": 7, "status": status, "created_at": "2024-01-15T10:30:00Z"}
        return (o, 0, at, json.dumps({"op": op, "after": row} if op != "d" else {"op": "d", "before": {"id": i}, "after": None}))

    job = P.CdcJob(f"{scratch}/out", tables=["orders"], apply_deletes=True, compact_every=1, bucketed=True, ledger_ranges=True)
    run = lambda rows, n: job.process(spark.createDataFrame(rows, MESSAGE), n)
    run([order(k, k, "created") for k in range(40)], 0)
    run([order(40, 3, "paid"), order(5, 5, "replayed"), order(41, 4, "", "d"), order(50, 9, "paid")], 1)
    run([order(40, 3, "paid"), order(45, 3, "done")], 2)
    run([order(45, 3, "done")], 2)  # run again
    got = {r.order_id: r.status for r in job.versioned(spark).orders().collect()}
    assert got[3] == "done" and got[5] == "created" and 4 not in got and got[9] == "paid" and len(got) == 39
    ranges = job.known_ranges(spark, 3).collect()
    assert sorted((r.lo, r.hi) for r in ranges) == [(0, 41), (45, 45), (50, 50)]
    held = job.versioned(spark).buckets("orders")
    assert held.newest() == 2 and set(held.manifest(2).values()) == {0, 1, 2}
