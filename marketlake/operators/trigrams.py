"""Substring search by a gram index with verification.

Every text is indexed by its distinct grams of one to three code points (lower-cased, as the
search is). A pattern of three and more looks up its grams of three, of which the ``RAREST`` rarest
choose the candidates; a shorter one is a gram itself. Candidates are then verified on the
texts, so the hits are those of a scan. Only the grams that some pattern needs are read, and a gram in
most texts is left to the rarer ones of its pattern.

Tasks follow the number of texts: grams are sorted, and candidates counted, in parts of about ``TASK_TEXTS`` texts.

Stored as ``grams`` (gram, doc_id), sorted by gram in buckets, and ``counts`` (gram, df).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONGEST = 3
RAREST = 3
BUCKETS = 32
TASK_TEXTS = 20_000


def grams(text: Column, sizes: Sequence[int] = (1, 2, 3)) -> Column:
    """The distinct grams of the given sizes of the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.char_length(low)

    def of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(low, i, F.lit(k)))
        return F.when(n >= k, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(k) for k in sizes]))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(texts: DataFrame, path: str, id_col: str = "id", text_col: str = "text") -> GramIndex:
    """Index ``texts`` under ``path`` (a folder all executors share). Ids are unique."""
    rows = texts.select(F.explode(grams(F.col(text_col))).alias("gram"), F.col(id_col).alias("doc_id"))
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // TASK_TEXTS))
    deals = max(8, -(-parts // BUCKETS))
    rows.withColumn("bucket", _bucket(F.col("gram"))).repartition(parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(deals))) \
        .sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    spark.read.parquet(f"{path}/grams").groupBy("gram").agg(F.count(F.lit(1)).alias("df")) \
        .write.mode("overwrite").parquet(f"{path}/counts")
    return GramIndex(spark, path, parts)


class GramIndex:
    """A stored gram index, see the module's text."""

    def __init__(self, spark: SparkSession, path: str, parts: int):
        self.parts = parts
        self.grams = spark.read.parquet(f"{path}/grams")
        self.counts = spark.read.parquet(f"{path}/counts")

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(pattern, doc_id): the texts that hold the rarest grams of the pattern; ``patterns`` has one column."""
        p = patterns.select("pattern").where("pattern IS NOT NULL AND pattern <> ''").distinct()
        size = F.char_length(F.lower("pattern"))
        low = F.col("pattern")
        own = F.when(size >= LONGEST, grams(low, (LONGEST,))).otherwise(F.array(F.lower("pattern")))
        need = p.select("pattern", F.explode(own).alias("gram")).join(self.counts, "gram", "left")
        order = Window.partitionBy("pattern").orderBy(F.col("df").asc_nulls_first(), "gram")
        need = need.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RAREST)
        need = need.select("pattern", "gram", _bucket(F.col("gram")).alias("bucket"),
                           F.count(F.lit(1)).over(Window.partitionBy("pattern")).alias("wanted"))
        # the grams are not sorted for the join; candidates go to their texts' tasks and are counted there
        found = self.grams.join(need.hint("shuffle_hash"), ["bucket", "gram"]).select("pattern", "doc_id", "wanted")
        found = found.repartition(self.parts, "doc_id").groupBy("pattern", "doc_id").agg(
            F.count(F.lit(1)).alias("found"), F.first("wanted").alias("wanted"))
        return found.where("found = wanted").select("pattern", "doc_id")

    def search(self, patterns: DataFrame, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """(pattern, doc_id) of every text that contains the pattern, in any case. The empty pattern is in every text."""
        t = texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
        hits = self.candidates(patterns).join(t, "doc_id").where(
            F.contains(F.lower("_text"), F.lower("pattern"))).select("pattern", "doc_id")
        empty = patterns.where("pattern = ''").select("pattern").distinct()
        return hits.unionByName(t.where("_text IS NOT NULL").join(F.broadcast(empty.limit(1))).select("pattern", "doc_id"))
