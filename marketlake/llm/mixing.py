"""Operator 6: mixing sources to target weights by capped water-filling (native).

Targets: sources, ordered by code point with null last, weigh 1, 2, 3, 1, 2, 3 ...
and share the budget (the sum of all sizes) by weight. A source is clamped at
``max_epochs`` times its own size, and what it cannot take is shared again by
weight until no target is above its cap. Sorted by cap over weight, the level
after clamping the first k sources is (budget - their caps) / (weights left); it
rises while clamping is due and falls afterwards, so its maximum is the feasible
level, and a target is min(cap, level x weight). That is the fixed point of the
clamp-and-reshare rounds, without running them one by one.

Sample: a document is taken floor(target / source size) times whole; the rest of
the target goes, one further time each, to the source's documents in seeded hash
order, and the document at the border is taken in part. A source's taken words
therefore equal its rounded target.

Scale: a source's running sum is built in two levels: sums of hash buckets of
about ``BUCKET_ROWS`` documents, then sums inside a bucket. A source that holds a
third of all rows just has more buckets. The only single-partition step is over
one row per source.

Defined results: null text has size 0; a null source is a source of its own; a
source without words has target 0; repeated rows are rows of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, durable, text_or_empty

BUCKET_ROWS = 2048
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def seeded_order(doc_id: Column, seed: int) -> Column:
    """A 60-bit number from MD5 of seed and id: the seeded order of documents."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text_or_empty(doc_id)).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, n_docs)`` -> the same with ``target`` (double).

    Works on one row per source; the windows without a partition are over these.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sources.withColumn("weight", 1 + (rank - 1) % 3)
    s = s.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - before).cast("double")
                     / left.cast("double"))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"),
                                       F.max("level").over(everything) * F.col("weight")))
    return s.select("source", "source_size", "n_docs", "target")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", max_epochs: int = 3, seed: int = 20240607,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: how many of its words the mix takes.

    Columns: ``doc_id, size, source_size, target, taken, source, seeded``.
    """
    sized = durable(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), seeded_order(F.col(id_col), seed).alias("seeded")))
    sources = water_fill(sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), max_epochs)
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn(
        "rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    sources = sources.withColumn("n_buckets", F.ceil(F.col("n_docs") / F.lit(bucket_rows)))
    sources = sources.withColumnRenamed("source", "of")

    bucket = F.floor(F.col("seeded") / F.lit(float(1 << HASH_BITS)) * F.col("n_buckets"))
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("bucket", bucket)
    sums = rows.groupBy("of", "bucket").agg(F.sum("size").alias("bucket_size"))
    in_order = Window.partitionBy("of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("of").alias("of_2"), F.col("bucket").alias("bucket_2"),
                       (F.sum("bucket_size").over(in_order) - F.col("bucket_size")).alias("before"))
    rows = rows.join(sums, F.col("of").eqNullSafe(F.col("of_2"))
                     & (F.col("bucket") == F.col("bucket_2")))
    inside = (Window.partitionBy("of", "bucket").orderBy("seeded", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.col("before") + F.sum("size").over(inside) - F.col("size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("whole") * F.col("size") + more).alias("taken"), "source", "seeded")


def write_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", max_epochs: int = 3, seed: int = 20240607) -> DataFrame:
    """The mixed documents, all columns, each repeated as often as it is taken.

    The one document a source that is taken in part is written whole, a document
    without words, which adds nothing to any target, once. Rows that repeat id,
    source and size are each written as often as the most taken of them.
    """
    copies = mix_sources(docs, id_col, text_col, source_col, max_epochs, seed).select(
        F.col("doc_id").alias("__mx_id"), F.col("source").alias("__mx_source"),
        F.col("size").alias("__mx_size"),
        F.when(F.col("size") == 0, F.lit(1)).otherwise(F.ceil(F.col("taken") / F.col("size")))
        .cast("int").alias("__mx_n"))
    key = ["__mx_id", "__mx_source", "__mx_size"]
    copies = copies.groupBy(*key).agg(F.max("__mx_n").alias("__mx_copies"))
    copies = copies.where("__mx_copies > 0").toDF(*[f"{k}_r" for k in key], "__mx_copies")
    keyed = docs.withColumns({key[0]: F.col(id_col), key[1]: F.col(source_col).cast("string"),
                              key[2]: word_count(F.col(text_col))})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in key]
    out = keyed.join(copies, same[0] & same[1] & same[2])
    out = out.withColumn("__mx_k", F.explode(F.sequence(F.lit(1), F.col("__mx_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
