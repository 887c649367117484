"""Steps whose memory must not grow with the table: no exploded or collected child is broadcast, no key gathers all rows."""
import pytest

from marketlake.operators import catalog as CAT
from marketlake.plans import registry
from pyspark.sql import functions as F

from conftest import SF001


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# a small catalog is under Spark's broadcast limit, as a large one is by Spark's estimate
@pytest.mark.parametrize("name", ["flat_catalog", "product_document_summary", "variants_after_item_delete", "product_cards", "option_rule_violations", "mapped_search_documents", "search_documents"])
def test_children_are_not_broadcast(spark, name):
    plan = _final_plan(registry.queries()[name](spark, SF001))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rows_without_a_key_are_dealt_over_tasks(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 3, F.col("id")).alias("fk"))
    out = CAT.fk_set_null(rows, ["fk"], spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"), "k")
    assert sorted(tuple(r) for r in out.where("id < 5").collect()) == [(0, None), (1, 1), (2, 2), (3, None), (4, None)]
    assert out.count() == 400
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(held) == 4 and max(held) < 200


def test_orders_beyond_the_stock_leave_before_demand_is_summed(spark, monkeypatch):
    from marketlake.operators import orders as ORD
    summed, ahead = [], ORD._ahead

    def watched(rows, bits):
        summed.extend(r[0] for r in rows.select("request_id").collect())
        return ahead(rows, bits)

    monkeypatch.setattr(ORD, "_ahead", watched)
    demand = spark.createDataFrame([(1, 7, 9, 5, 1), (1, 8, 1, 5, 1), (2, 7, 3, 5, 2), (3, 7, 3, 5, 3), (4, 8, 5, 5, 4)],
                                   "request_id long, variant_id long, qty long, stock int, ts long")
    assert sorted(r[0] for r in ORD.allocate(demand).collect()) == [2, 4]
    assert 1 not in summed and {2, 3} <= set(summed)


def test_postings_are_not_shuffled_by_term(spark):
    from marketlake.operators import search as S
    docs = spark.createDataFrame([(i, "bolt nut") for i in range(9)], "id long, name string")
    terms = S.query_terms(spark.createDataFrame([(1, "bolt")], "query_id long, query string"))
    found = S.bm25_text_field(docs, "id", "name", terms, F.lit(9), F.lit(2.0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    assert found.count() == 9


def test_blocks_are_scored_without_a_shuffle_of_matches(spark, scratch):
    from marketlake.operators import postings as P
    docs = spark.range(60).selectExpr("id", "concat('bolt w', id) AS name", "concat('bolt nut w', id % 7) AS description", "'c' AS category")
    index = P.build(docs, f"{scratch}/index", slot_docs=8)
    terms = index.query_terms(spark.createDataFrame([(1, "bolt w3"), (2, "nut")], "query_id long, query string"), {"name": 3.0, "description": 1.0, "category": 2.0})
    wanted = index.bounds(terms).where("slot < 3")
    plan = index.scored(terms, wanted)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffled if "query_id" in line and "doc_id" in line]
    assert [line for line in shuffled if "hashpartitioning(slot" in line and "REPARTITION_BY_NUM" in line]
    # the postings of a slot lie in one file
    held = spark.read.parquet(f"{scratch}/index/postings").select("slot", F.input_file_name().alias("file")).distinct()
    assert held.groupBy("slot").count().where("count > 1").isEmpty()


def test_texts_are_split_once_a_row(spark):
    from marketlake.operators import postings as P
    docs = spark.range(3).selectExpr("id AS doc_id", "id AS slot", "repeat('a b c d ', 20000) AS name")
    assert sorted((r.term, r.tf, r.dl) for r in P._entries(docs, ["name"], []).where("doc_id = 1").collect()) == [
        (t, 20000, 80000) for t in "abcd"]


def test_items_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from marketlake.operators import violations as V
    monkeypatch.setattr(V, "TASK_ITEMS", 100)
    items = spark.range(1000).selectExpr("id AS item_id", "id div 2 AS order_id", "id % 3 AS product_id", "1L AS seller_id", "1 AS quantity")
    orders, sellers = spark.range(500).toDF("order_id"), spark.range(2).toDF("seller_id")
    parts = V.tasks(spark, items.count())
    assert parts == 10
    found = V.check(items.unionByName(items.where("item_id = 6").selectExpr("5000L AS item_id", *items.columns[1:])), orders.where("order_id <> 9"), sellers, parts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("order_id#") and "ShuffledHashJoin" in plan
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) >= 2 and all(", 10)" in line for line in dealt)
    assert sorted(map(tuple, found.collect())) == [("duplicate_line", 6), ("duplicate_line", 5000), ("orphan_order", 18), ("orphan_order", 19)]


def test_candidates_are_counted_in_their_texts_tasks(spark, scratch, monkeypatch):
    from marketlake.operators import trigrams as T
    monkeypatch.setattr(T, "TASK_TEXTS", 10)
    texts = spark.range(90).selectExpr("id", "concat('bolt ', id) AS text")
    patterns = spark.createDataFrame([("olt",), ("t 8",), ("zq",)], "pattern string")
    index = T.build(texts, f"{scratch}/grams")
    found = index.candidates(patterns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", 9), REPARTITION_BY_NUM" in plan and "hashpartitioning(pattern" not in plan.split("ShuffledHashJoin")[0]
    got = sorted((r.pattern, r.doc_id) for r in index.search(patterns, texts).collect())
    assert got == sorted([("olt", i) for i in range(90)] + [("t 8", i) for i in [8, *range(80, 90)]])
