"""Shared helpers of the corpus operators: tables, scratch tables, driver-safe models.

Every operator selects the columns it needs first and names its own columns,
so extra or clashing columns of the input never reach its plan.
"""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

# The six ASCII white-space characters of the contracts: U+0020, U+0009-U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master, where every task sees the driver's disk, gets a
    temporary folder when the setting is missing; elsewhere that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="corpus-scratch-")
    sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps the columns prunable and
    compressed; a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-ops/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables, once no result over them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark)}/corpus-ops/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that a scratch table has replaced.

    Its cleaner follows the garbage collector, which a driver that holds only
    plans may not run for a long time.
    """
    for _ in range(2):  # the second pass finds what the first one's finalisers let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def sent(spark: SparkSession, model):
    """Broadcast a model of this package by value: the tasks need no copy of the package.

    A broadcast's own pickling names classes by their module. Read it with ``received``.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(model):
    """What ``sent`` broadcast."""
    return pickle.loads(model.value)


def with_text_id(docs: DataFrame, id_col: str, text: Column) -> tuple[DataFrame, DataType]:
    """``(doc_id, text)`` with the id as a string, and the id's type to cast back to.

    A null would turn a column of whole numbers into floats in pandas.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), text.alias("text")), kind


def text_or_empty(col: Column) -> Column:
    """The text, null as empty, in whatever type the column came."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(doc_id: Column, n: int) -> Column:
    """``crc32(doc_id as text) mod n``; a null id counts as the empty text."""
    return F.crc32(text_or_empty(doc_id).cast("binary")) % F.lit(n)
