import hashlib
import random
import re

from marketlake.llm import exact_dedup as X
from pyspark.sql import functions as F

from .texts import sentence


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(r[0], keep, len(members), r[0] == keep, sha) for r in members]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def corpus():
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (7, "a b"), (8, "A b"),
            (9, long), (10, long + " "), (11, long[:-1] + "x"), (None, "null id"), (12, "nullid"),
            (13, "same"), (13, "same"), (14, "中\U0001F600" * 900), (15, " " + "中\U0001F600" * 900)]
    rows += [(100 + i, "copied " * 50) for i in range(60)]
    return rows


def test_equal_texts_meet(docs):
    rows = corpus()
    assert rows_of(X.exact_dedup(docs(rows))) == expected(rows)


def test_chunks_give_the_text_back(spark):
    rng = random.Random(5)
    texts = ["", "x", sentence(rng, 5000).replace(" ", ""), "中" * 5000, "a b" * 900]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.chunks(F.col("t")).alias("c"))
    for r in df.collect():
        assert "".join(r["c"]) == r["t"]
        assert all(len(c) <= X.MAX_CHUNK for c in r["c"])


def test_chunks_follow_content(spark):
    rng = random.Random(6)
    t = sentence(rng, 4000).replace(" ", "")
    df = spark.createDataFrame([(t,), ("zq" + t,)], "t string").select(X.chunks(F.col("t")).alias("c"))
    a, b = [set(r["c"]) for r in df.collect()]
    assert len(a & b) > 0.8 * len(a)


def test_colliding_identifiers_are_told_apart(docs):
    weak = lambda c: (F.length(c).cast("long"), F.lit(0).cast("long"))
    rows = [(1, "abc"), (2, "abd"), (3, "a bc"), (4, "xyz")]
    assert rows_of(X.exact_dedup(docs(rows), identify=weak)) == expected(rows)


def test_kept_documents_and_empty_table(docs):
    rows = corpus()
    kept = X.keep_first_of_equal(docs(rows))
    assert kept.columns == docs(rows).columns
    want = {(r[0], r[4]) for r in expected(rows) if r[3]}
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len(want) and {r["doc_id"] for r in got} == {w[0] for w in want}
    assert X.exact_dedup(docs([])).count() == 0 and X.keep_first_of_equal(docs([])).count() == 0


def test_a_hot_group_is_split(spark):
    """A third of the rows equal: the join that hands the group's result back is split in the final plan."""
    keep = {k: spark.conf.get(k, None) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(keep, ("4k", "4k", "1.5", "-1", "40")):
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id % 9000) END AS text")
        out = X.exact_dedup(df.repartition(30))
        rows = out.collect()
        assert sum(r.group_size > 6000 for r in rows) > 6000 and "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
