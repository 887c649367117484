"""CSV catalog source, file-stem category, bootstrap guard, schemas."""
import os

from marketlake import schemas
from marketlake.sources import files as FS


def test_csv_catalog_policies(spark, scratch):
    d = f"{scratch}/csv"
    os.makedirs(d)
    with open(f"{d}/Books.Fiction.csv", "w") as f:
        f.write("name,main_category,sub_category,image,link,ratings,no_of_ratings,discount_price,actual_price\n")
        f.write('A book,,novels,i.jpg,l,4.2,"30,227","₹1,099","₹1,299.50"\n')
        f.write("Bad,,novels,i.jpg,l,x,12,N/A,Get\n")
    raw = FS.read_csv_catalog(spark, d)
    digits = {r.product_name: r for r in FS.csv_to_products(raw, "digits").collect()}
    assert digits["A book"].main_category == "Books"
    assert float(digits["A book"].external_price) == 1299.50
    assert digits["A book"].external_ratings_count == 30227
    assert digits["Bad"].reject_reason == "bad external_price"
    rupee = {r.product_name: r for r in FS.csv_to_products(raw, "rupee").collect()}
    assert rupee["A book"].external_price == 1299.5 and rupee["Bad"].external_price == 0.0
    comma = {r.product_name: r for r in FS.csv_to_products(raw, "comma_decimal").collect()}
    assert comma["A book"].external_ratings_count == 30
    assert comma["A book"].description == "Description for A book"


def test_bootstrap_guard(spark, scratch):
    path = f"{scratch}/t"
    df = spark.range(3)
    assert FS.bootstrap(spark, df, path) is True
    assert FS.bootstrap(spark, df, path) is False
    assert spark.read.parquet(path).count() == 3


def test_schemas_parse(spark):
    for ddl in list(schemas.SOURCE_TABLES.values()) + list(schemas.ANALYTICS_TABLES.values()):
        assert schemas.struct(ddl).fields
    df = schemas.conform(spark.range(2).withColumnRenamed("id", "order_id"), schemas.ANALYTICS_TABLES["orders"])
    assert df.columns[:2] == ["order_id", "order_date"]


def test_upsert_documents_keeps_latest(spark, scratch):
    import datetime as dt
    docs = spark.createDataFrame([(1, "old", dt.datetime(2024, 1, 1)), (1, "new", dt.datetime(2024, 1, 2)),
                                  (2, "only", dt.datetime(2024, 1, 1))], "id long, name string, etl_updated_at timestamp")
    FS.upsert_documents(docs, f"{scratch}/docs")
    got = {r.id: r.name for r in FS.read_documents(spark, f"{scratch}/docs").collect()}
    assert got == {1: "new", 2: "only"}
    later = spark.createDataFrame([(2, "changed", dt.datetime(2024, 1, 3)), (3, "added", dt.datetime(2024, 1, 1)),
                                   (1, "stale", dt.datetime(2023, 1, 1))], docs.schema)
    FS.upsert_documents(later, f"{scratch}/docs")
    got = {r.id: r.name for r in FS.read_documents(spark, f"{scratch}/docs").collect()}
    assert got == {1: "new", 2: "changed", 3: "added"}  # documents outside the batch stay


def test_an_unreadable_target_is_an_error(spark, scratch):
    import pytest
    seed = spark.range(5).withColumnRenamed("id", "order_id")
    seed.write.orc(f"{scratch}/orc")
    with pytest.raises(Exception):
        FS.bootstrap(spark, seed, f"{scratch}/orc")
    assert spark.read.orc(f"{scratch}/orc").count() == 5
    with pytest.raises(Exception):
        FS.read_table(spark, f"{scratch}/orc", "order_id bigint").collect()
    assert FS.read_table(spark, f"{scratch}/never", "order_id bigint").count() == 0


def test_kafka_options_never_skip_lost_offsets_by_default():
    from marketlake.sources import stream as ST
    o = ST.kafka_options("h:1")
    assert o["failOnDataLoss"] == "true" and "maxOffsetsPerTrigger" not in o
    assert ST.kafka_options("h:1", 7, accept_lost_offsets=True)["failOnDataLoss"] == "false"


def test_no_machine_local_checkpoint_on_a_cluster():
    import pytest
    from types import SimpleNamespace
    from marketlake.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_second_precision(spark):
    import datetime as dt
    from marketlake.functions import dates as D
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 999999),)], "t timestamp_ntz")
    assert df.select(D.second_precision("t")).first()[0] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_transform_registry_accepts_pandas_udf(spark):
    import json

    import pandas as pd
    from pyspark.sql import functions as F

    from marketlake.functions import registry as REG
    from marketlake.operators import cdc as CDC

    @F.pandas_udf("string")
    def title(s: pd.Series) -> pd.Series:
        return s.str.title()

    rows = [("postgres.public.products", 0, 0, json.dumps({"op": "c", "after": {"id": 1, "product_name": "blue bolt"}}))]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, value string")
    REG.register_transform("products", "product_name", title)
    try:
        out = CDC.to_table(CDC.decode(df), "products", F.current_timestamp()).first()
    finally:
        REG.reset_transforms()
    assert out.product_name == "Blue Bolt" and out.external_price == 0


def test_jdbc_read_options():
    import pytest as _pytest
    from marketlake.sources import jdbc as J
    o = J.read_options("jdbc:postgresql://db/shop", "orders", partition_column="id", lower=1, upper=1000,
                       num_partitions=8, where="status <> 'cancelled'")
    assert o["numPartitions"] == "8" and o["partitionColumn"] == "id"
    assert o["dbtable"].startswith("(SELECT * FROM orders WHERE status")
    with _pytest.raises(ValueError):
        J.read_options("jdbc:x", "orders", partition_column="id")
