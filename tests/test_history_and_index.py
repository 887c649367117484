"""Ledger ranges, validity and as-of joins, gram index, numbered lists, contested allocation."""
import random

import pytest
from pyspark.sql import functions as F

from marketlake.operators import asof as A
from marketlake.operators import catalog as CAT
from marketlake.operators import ledger as L
from marketlake.operators import orders as ORD
from marketlake.operators import trigrams as T


def offsets(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long")


def ranges(df):
    return sorted((r.topic, r.partition, r.lo, r.hi) for r in df.collect())


def test_ranges_follow_the_gaps(spark):
    rows = [("t", 0, o) for o in [*range(0, 500), *range(501, 900), 5000, 2**62, 2**62 + 1]] + [("t", 1, -3), ("t", 1, -2), ("u", 1, 7), ("u", 1, 7)]
    rng = random.Random(1)
    rng.shuffle(rows)
    got = L.intervals(offsets(spark, rows), width=64)
    want = [("t", 0, 0, 499), ("t", 0, 501, 899), ("t", 0, 5000, 5000), ("t", 0, 2**62, 2**62 + 1), ("t", 1, -3, -2), ("u", 1, 7, 7)]
    assert ranges(got) == want
    # out of order, overlapping and replayed batches end in the same ledger
    parts = [L.intervals(offsets(spark, rows[i::3] + rows[:40]), width=64) for i in range(3)]
    assert ranges(L.merged(parts[2].unionByName(parts[0]).unionByName(parts[1]))) == want


def test_range_anti_join(spark):
    done = offsets(spark, [("t", 0, o) for o in range(100, 400) if o % 50] + [("t", 1, 5)])
    batch = offsets(spark, [("t", 0, o) for o in range(90, 410)] + [("t", 0, 250), ("t", 1, 5), ("t", 1, 6), ("v", 0, 5)])
    got = sorted((r.topic, r.partition, r.offset) for r in L.unprocessed(batch, L.intervals(done, 32), 32).collect())
    want = [("t", 0, o) for o in range(90, 410) if o < 100 or o >= 400 or o % 50 == 0] + [("t", 0, 250), ("t", 1, 6), ("v", 0, 5)]
    assert got == sorted(want)
    assert L.unprocessed(batch, L.intervals(done.limit(0))).count() == batch.count()


def test_asof_and_validity_against_a_scan(spark):
    rng = random.Random(2)
    right = sorted({(rng.choice("abc"), rng.randrange(300)) for _ in range(120)})
    left = [(rng.choice(["a", "a", "b", "c", "d", None]), rng.choice([None, *range(-5, 320)]), i) for i in range(400)]
    r = spark.createDataFrame([(k, t, f"{k}{t}") for k, t in right], "k string, t int, v string")
    l = spark.createDataFrame(left, "k string, at int, i int")
    got = {x.i: x.v for x in A.asof_join(l, r, ["k"], "at", "t", ["v"], A.by_range(16)).collect()}
    want = {i: max(((t, f"{k}{t}") for q, t in right if q == k and at is not None and t <= at), default=(0, None))[1] for k, at, i in left}
    assert got == want
    upto = {(x.k, x.t): x.valid_to for x in A.validity(r, ["k"], "t", A.by_range(16)).collect()}
    assert upto == {(k, t): min((u for q, u in right if q == k and u > t), default=None) for k, t in right}


def test_substrings_of_any_length(spark, scratch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abÀ ß%_") for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, "", "ab", "x" * 5000]
    df = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)], "id long, text string, gram string")
    asked = ["", "a", "B", "ab", "AbÀ", "à", "%_", "a%", "ab a", "zzz", "x" * 4000, "ß", "ba ba"]
    patterns = spark.createDataFrame([(p,) for p in [*asked, "ab", None]], "pattern string")
    got = sorted((r.pattern, r.doc_id) for r in T.build(df, f"{scratch}/grams").search(patterns, df).collect())
    assert got == sorted((p, i) for p in asked for i, t in enumerate(texts) if t is not None and p.lower() in t.lower())


@pytest.mark.parametrize("keys", [[5, 7, 1000, 10**12], list(range(0, 900, 3)), [4], []])
def test_numbered_lists(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted((r.k, r.number) for r in CAT.numbered(df, "k").collect()) == [(k, i) for i, k in enumerate(sorted(keys))]


def test_round_robin_over_sparse_keys(spark):
    items = spark.createDataFrame([(k * 7 + 3,) for k in range(50)], "item long")
    sellers = spark.createDataFrame([(s,) for s in (9, 2, 40)], "seller long")
    got = sorted((r.item, r.seller) for r in CAT.round_robin(items, "item", sellers, "seller").collect())
    assert got == [(k * 7 + 3, (2, 9, 40)[k % 3]) for k in range(50)]


def test_allocation_serves_in_order(spark):
    rng = random.Random(4)
    stock = {v: rng.randrange(0, 30) for v in range(12)}
    demand = [(o, v, rng.randrange(1, 9), stock[v], o // 7) for o in range(120) for v in rng.sample(range(12), rng.randrange(1, 4))]
    left, given = dict(stock), set()
    for o in range(120):
        mine = [(v, q) for p, v, q, _, _ in demand if p == o]
        if all(left[v] >= q for v, q in mine):
            given.add(o)
            for v, q in mine:
                left[v] -= q
    df = spark.createDataFrame(demand, "request_id long, variant_id long, qty long, stock long, ts long")
    got = [r.request_id for r in ORD.allocate(df, bucket_bits=3).collect()]
    assert sorted(got) == sorted(given)
    assert ORD.allocate(df.limit(0)).count() == 0
    assert df.where(F.col("qty") < 0).count() == 0
