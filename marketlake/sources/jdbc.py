"""Relational snapshot reads and appends over JDBC.

Reads are split into ``num_partitions`` parallel range queries on a numeric
key (``partitionColumn`` / ``lowerBound`` / ``upperBound``), so a large
source table is not pulled through one connection; predicates given to
``where`` become part of the pushed query. The JDBC driver jar must be on
the cluster's classpath (none is bundled here, so these helpers are exercised
only through their option building in tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

# Fixed value: rows per insert batch of an append.
WRITE_BATCH_SIZE = 10_000


def read_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                 num_partitions: int = 64, where: str | None = None, fetch_size: int = 10_000) -> dict:
    src = f"(SELECT * FROM {table} WHERE {where}) AS t" if where else table
    opts = {"url": url, "dbtable": src, "fetchsize": str(fetch_size)}
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    if partition_column:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(num_partitions)})
    return opts


def read_table(spark: SparkSession, url: str, table: str, **kw) -> DataFrame:
    """Snapshot of a source table, conformed to its fixed schema."""
    df = spark.read.format("jdbc").options(**read_options(url, table, **kw)).load()
    ddl = schemas.SOURCE_TABLES.get(table)
    return schemas.conform(df, ddl) if ddl else df


def append_table(df: DataFrame, url: str, table: str, user: str | None = None, password: str | None = None,
                 batch_size: int = WRITE_BATCH_SIZE, num_partitions: int | None = None) -> None:
    """Append rows in batched inserts, one connection per write partition."""
    if num_partitions:
        df = df.coalesce(num_partitions)  # bound the number of concurrent connections
    w = df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table) \
        .option("batchsize", str(batch_size))
    if user:
        w = w.option("user", user)
    if password:
        w = w.option("password", password)
    w.save()
