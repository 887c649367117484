"""Stored postings with block maxima: the best hits of a batch of queries without scoring every pair.

Documents are dealt to *slots* of about ``slot_docs`` by length, so that a slot's documents have
like length norms; all fields and terms share the slots. A block is one (field, term, slot): its
postings, their number and the largest BM25 part ``max_w`` among them. Stored under a folder:

    postings/   slot, doc_id, field, term, tf, dl; a slot's rows lie in one file
    blocks/     field, term, slot, n, max_w: the heads of the blocks
    terms/      field, term, df (over all documents)
    sizes/      doc_id and the length of each text field
    stats/      n documents and the average length of each text field

Search, for all queries at once:

1. The block heads of a query's terms (no postings read) give each (query, slot) an upper bound:
   per field the sum of qtf * idf * max_w, times the boost; over fields the largest.
2. The ``seed_slots`` slots of the largest bounds are scored. The k-th best score there is a
   threshold that the final k-th best cannot fall below.
3. A slot whose bound is below the threshold holds no hit; its postings are not read. The others are
   scored exactly as the exhaustive search does, so the hits are the same.

A term in every document is one block a slot, so a hot term's heads are a hundredth of its
postings and spread over slots. Documents are shuffled by slot before they become postings, and postings by
slot when they are scored, so a document's parts are summed where they are; the batch's query terms go to
them by broadcast, as in ``operators/search.py``. The tasks are as many as the documents ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import search as S

SLOT_DOCS = 128
SEED_SLOTS = 4
TASK_DOCS = 4096  # a document's score rows are many times its text


def slots(docs: DataFrame, id_col: str, text_fields: Sequence[str], slot_docs: int = SLOT_DOCS) -> DataFrame:
    """(doc_id, slot): slots of about ``slot_docs`` documents, in order of length.

    The running count is over distinct lengths, not documents; documents of one length are dealt by hash.
    """
    size = sum((F.size(S.tokenize(f)) for f in text_fields), F.lit(0))
    return _dealt(docs.select(F.col(id_col).alias("doc_id"), size.alias("size")), slot_docs)


def _dealt(sized: DataFrame, slot_docs: int) -> DataFrame:
    per = sized.groupBy("size").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    per = per.select(F.col("size").alias("of"), "m", (upto - F.col("m")).alias("before"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = sized.join(per, F.col("size") == F.col("of"))
    return rows.select("doc_id", F.floor((F.col("before") + F.floor(share * F.col("m"))) / F.lit(slot_docs)).alias("slot"))


def _entries(docs: DataFrame, text_fields: Sequence[str], keyword_fields: Sequence[str]) -> DataFrame:
    """(slot, doc_id, field, term, tf, dl) of all fields; the rows stay where their documents are."""
    kind = "array<struct<field:string,term:string,tf:bigint,dl:int>>"

    def entry(field: str, term: Column, tf: Column, dl: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), term.alias("term"), tf.alias("tf"), dl.alias("dl"))

    def of_field(field: str, counts: Column, dl: Column) -> Column:
        return F.transform(counts, lambda p: entry(field, p["term"], p["tf"], dl)).cast(kind)

    lists = []
    for i, f in enumerate(text_fields):
        docs, counts, dl = S.term_counts(docs, f, str(i))
        lists.append(of_field(f, counts, dl))
    for f in keyword_fields:  # a whole value is one term, without a length norm
        one = F.array(entry(f, F.col(f), F.lit(1).cast("bigint"), F.lit(1))).cast(kind)
        lists.append(F.when(F.col(f).isNotNull(), one).otherwise(F.array().cast(kind)))
    return docs.select("slot", "doc_id", F.explode(F.concat(*lists)).alias("p")).select("slot", "doc_id", "p.*")


def _part(stats: DataFrame, text_fields: Sequence[str]) -> Column:
    """What a posting adds to its field's score, but for qtf and idf; a keyword's is 1."""
    part = F.lit(1.0)
    for f in text_fields:
        norm = F.col("tf") + F.lit(S.K1) * (F.lit(1 - S.B) + F.lit(S.B) * F.col("dl") / stats.select(f"avg_{f}").scalar())
        part = F.when(F.col("field") == f, F.col("tf") * F.lit(S.K1 + 1) / norm).otherwise(part)
    return part


def build(docs: DataFrame, path: str, id_col: str = "id", text_fields: Sequence[str] = ("name", "description"),
          keyword_fields: Sequence[str] = ("category",), slot_docs: int = SLOT_DOCS) -> PostingIndex:
    """Write the index of ``docs`` under ``path`` (a folder all executors share)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), *text_fields, *keyword_fields)
    sizes = [F.size(S.tokenize(f)).alias(f"size_{f}") for f in text_fields]
    docs.select("doc_id", *sizes).write.mode("overwrite").parquet(f"{path}/sizes")
    sized = spark.read.parquet(f"{path}/sizes")
    n = F.count(F.lit(1))
    sized.select(n.alias("n"), *[F.coalesce(F.try_divide(
        F.sum(f"size_{f}").cast("double"), n.cast("double")), F.lit(0.0)).alias(f"avg_{f}")
        for f in text_fields]).write.mode("overwrite").parquet(f"{path}/stats")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized.count() // TASK_DOCS))
    size = sum((F.col(f"size_{f}") for f in text_fields), F.lit(0))
    slot = _dealt(sized.select("doc_id", size.alias("size")), slot_docs)
    # texts are not sorted for the join; a number of partitions of its own, so that none are merged
    placed = docs.join(slot.hint("shuffle_hash"), "doc_id").repartition(parts, "slot")
    _entries(placed, text_fields, keyword_fields).write.mode("overwrite").parquet(f"{path}/postings")
    stats = spark.read.parquet(f"{path}/stats")
    spark.read.parquet(f"{path}/postings").withColumn("w", _part(stats, text_fields)).groupBy("field", "term", "slot").agg(
        n.alias("n"), F.max("w").alias("max_w")).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("field", "term").agg(F.sum("n").alias("df")) \
        .write.mode("overwrite").parquet(f"{path}/terms")
    return PostingIndex(spark, path, text_fields, keyword_fields, parts)


class PostingIndex:
    """A stored index, see the module's text."""

    def __init__(self, spark: SparkSession, path: str, text_fields: Sequence[str], keyword_fields: Sequence[str], parts: int):
        self.text_fields, self.keyword_fields, self.parts = list(text_fields), list(keyword_fields), parts
        self.postings = spark.read.parquet(f"{path}/postings")
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.terms = spark.read.parquet(f"{path}/terms")
        self.stats = spark.read.parquet(f"{path}/stats")

    def query_terms(self, queries: DataFrame, boosts: dict[str, float]) -> DataFrame:
        """(query_id, field, term, qtf, idf, boost) of the terms that some document holds."""
        q = queries.filter(F.length(F.trim("query")) >= S.MIN_QUERY_LEN)
        words = S.query_terms(q).select("query_id", "term", "qtf")
        whole = q.select("query_id", F.col("query").alias("term"), F.lit(1).cast("bigint").alias("qtf"))
        parts = [words.withColumn("field", F.lit(f)) for f in self.text_fields]
        parts += [whole.withColumn("field", F.lit(f)) for f in self.keyword_fields]
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        boost = F.create_map(*[F.lit(x) for f in [*self.text_fields, *self.keyword_fields] for x in (f, float(boosts[f]))])
        idf = S._idf(self.stats.select("n").scalar(), F.col("df"))
        return rows.join(self.terms, ["field", "term"]).select(
            "query_id", "field", "term", "qtf", idf.alias("idf"), boost[F.col("field")].alias("boost"))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(query_id, slot, bound, n): what a document of the slot can score at most, and the postings behind it."""
        per = self.blocks.join(F.broadcast(terms), ["field", "term"]).groupBy("query_id", "slot", "field").agg(
            (F.first("boost") * F.sum(F.col("qtf") * F.col("idf") * F.col("max_w"))).alias("bound"), F.sum("n").alias("n"))
        return per.groupBy("query_id", "slot").agg(F.max("bound").alias("bound"), F.sum("n").alias("n"))

    def scored(self, terms: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of the documents in the wanted (query_id, slot), as the exhaustive search scores them."""
        held = F.broadcast(terms.select("field", "term").distinct())
        asked = self.postings.join(held, ["field", "term"], "left_semi").repartition(self.parts, "slot")
        # a batch's queries are few, so a slot's list of them is short
        by_slot = wanted.groupBy("slot").agg(F.collect_set("query_id").alias("wanted"))
        found = asked.join(by_slot.hint("shuffle_hash"), "slot").join(F.broadcast(terms), ["field", "term"]).where(
            F.array_contains("wanted", F.col("query_id")))
        part = F.col("idf") * _part(self.stats, self.text_fields) * F.when(
            F.col("field").isin(self.text_fields), F.col("qtf")).otherwise(F.lit(1))
        per = found.groupBy("slot", "query_id", "doc_id", "field").agg((F.first("boost") * F.sum(part)).alias("score"))
        return per.groupBy("slot", "query_id", "doc_id").agg(
            F.round(F.max("score"), S.SCORE_DECIMALS).alias("score")).drop("slot")

    def thresholds(self, terms: DataFrame, bounds: DataFrame, k: int, seed_slots: int,
                   keep: DataFrame | None = None) -> DataFrame:
        """(query_id, least): the k-th best score in the slots of the largest bounds, where they hold k hits."""
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slot")
        seeds = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= seed_slots)
        found = self._kept(self.scored(terms, seeds), keep)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select(
            "query_id", F.col("score").alias("least"))

    @staticmethod
    def _kept(scores: DataFrame, keep: DataFrame | None) -> DataFrame:
        return scores if keep is None else scores.join(keep, "doc_id", "left_semi")

    def read_and_skipped(self, queries: DataFrame, k: int = S.TOP_HITS, boosts: dict[str, float] = S.FIELD_BOOSTS,
                         seed_slots: int = SEED_SLOTS, keep: DataFrame | None = None) -> DataFrame:
        """(query_id, slot, n, skipped): the postings behind every (query, slot), and whether they are skipped."""
        terms = self.query_terms(queries, boosts)
        bounds = self.bounds(terms)
        least = self.thresholds(terms, bounds, k, seed_slots, keep)
        # scores are rounded, so a bound may be under the threshold by half a unit of the last place
        below = F.col("bound") < F.col("least") - F.lit(10.0 ** -S.SCORE_DECIMALS)
        return bounds.join(least, "query_id", "left").select(
            "query_id", "slot", "n", F.coalesce(below, F.lit(False)).alias("skipped"))

    def search(self, queries: DataFrame, k: int = S.TOP_HITS, boosts: dict[str, float] = S.FIELD_BOOSTS,
               seed_slots: int = SEED_SLOTS, keep: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the best ``k`` documents of each query; of those in ``keep`` (doc_id), if given."""
        terms = self.query_terms(queries, boosts)
        wanted = self.read_and_skipped(queries, k, boosts, seed_slots, keep).where(~F.col("skipped"))
        hits = self._kept(self.scored(terms, wanted), keep)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(
            "rank", F.col("rank").cast("bigint"))
