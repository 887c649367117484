"""Block-max search equals the exhaustive one, and skips postings."""
import random

from pyspark.sql import functions as F

from marketlake.operators import postings as P
from marketlake.operators import search as S


def corpus(spark):
    rng = random.Random(8)
    words = ["common"] * 30 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 8]))),
             " ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 400]))), f"c{i % 4}", float(i % 6)) for i in range(600)]
    rows += [(600 + i, "common rare gem", "common rare gem", "rare gem", 5.0) for i in range(15)]
    rows += [(900, None, None, None, None), (901, "", "", "", 0.0)]
    return spark.createDataFrame(rows, "id long, name string, description string, category string, rating double")


def queries(spark):
    return spark.createDataFrame([(1, "common rare gem"), (2, "rare gem"), (3, "w1 w2 common common"), (4, "c3"),
                                  (5, "nothing here"), (6, "x"), (7, "w7"), (8, "")], "query_id long, query string")


def hits(df, doc):
    return sorted((r.query_id, r["rank"], r[doc], r.score) for r in df.collect())


def test_same_hits_and_fewer_postings(spark, scratch):
    docs, q = corpus(spark), queries(spark)
    index = P.build(docs, f"{scratch}/index", slot_docs=16)
    assert hits(index.search(q, k=10), "doc_id") == hits(S.search(docs, q, k=10), "id")
    read = index.read_and_skipped(q, k=10).groupBy("skipped").agg(F.sum("n").alias("n"))
    counts = {r.skipped: r.n for r in read.collect()}
    assert counts[True] > 0.4 * sum(counts.values())


def test_filters_hold_for_the_threshold(spark, scratch):
    docs, q = corpus(spark), queries(spark)
    index = P.build(docs, f"{scratch}/index", slot_docs=16)
    keep = docs.where("category = 'c3' AND rating >= 3").select(F.col("id").alias("doc_id"))
    want = S.search(docs, q, category="c3", min_rating=3.0, k=10)
    assert hits(index.search(q, k=10, keep=keep), "doc_id") == hits(want, "id")


def test_slots_are_bounded_and_ordered(spark):
    docs = corpus(spark)
    got = P.slots(docs, "id", ("name", "description"), 16).groupBy("slot").agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in got) <= 48 and len(got) >= 30
