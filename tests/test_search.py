"""Search vs a brute-force BM25 in plain Python on a small fixture."""
import math
import re

import pytest

from marketlake.operators import search as S

DOCS = [
    (1, "Blue bolt", "a strong blue steel bolt", "hardware", 4.5),
    (2, "Red widget", "widget for the blue machine", "tools", 3.0),
    (3, "Bolt cutter", "cuts any bolt, bolt after bolt", "tools", 5.0),
    (4, "Élan vital", "été déjà vu, bolt", "hardware", 4.0),
]


def _tok(s):
    return [t for t in re.split(r"[^\w]+|_", (s or "").lower()) if t]


def brute(query, field_idx, boost):
    n = len(DOCS)
    toks = {d[0]: _tok(d[field_idx]) for d in DOCS}
    avgdl = sum(len(t) for t in toks.values()) / n
    q = _tok(query)
    out = {}
    for did, t in toks.items():
        s = 0.0
        for term in set(q):
            tf = t.count(term)
            if not tf:
                continue
            df = sum(1 for x in toks.values() if term in x)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            s += q.count(term) * idf * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * len(t) / avgdl))
        if s:
            out[did] = s * boost
    return out


def test_bm25_best_fields_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "id long, name string, description string, category string, rating double")
    queries = spark.createDataFrame([(1, "blue bolt"), (2, "bolt"), (3, "hardware"), (4, "x")],
                                    "query_id long, query string")
    hits = S.search(docs, queries, "id").collect()
    got = {(r.query_id, r.id): r.score for r in hits}
    for qid, q in [(1, "blue bolt"), (2, "bolt")]:
        name, desc = brute(q, 1, 3.0), brute(q, 2, 1.0)
        for did in set(name) | set(desc):
            assert got[(qid, did)] == pytest.approx(max(name.get(did, 0), desc.get(did, 0)), abs=1e-4)
    # keyword field: exact whole-value match only
    assert {k[1] for k in got if k[0] == 3} == {1, 4}
    assert not any(k[0] == 4 for k in got)  # query shorter than 2 chars


def test_filters_do_not_change_scores(spark):
    docs = spark.createDataFrame(DOCS, "id long, name string, description string, category string, rating double")
    q = spark.createDataFrame([(1, "bolt")], "query_id long, query string")
    all_hits = {r.id: r.score for r in S.search(docs, q, "id").collect()}
    filt = {r.id: r.score for r in S.search(docs, q, "id", category="tools", min_rating=4.5).collect()}
    assert set(filt) == {3} and filt[3] == all_hits[3]


def test_tokenize_keeps_accents(spark):
    df = spark.createDataFrame([("Été déjà-vu 42x",)], "t string")
    assert df.select(S.tokenize("t")).first()[0] == ["été", "déjà", "vu", "42x"]


def test_min_rating_bounds(spark):
    docs = spark.createDataFrame(DOCS, "id long, name string, description string, category string, rating double")
    q = spark.createDataFrame([(1, "bolt")], "query_id long, query string")
    with pytest.raises(ValueError):
        S.search(docs, q, "id", min_rating=6)


def test_building_a_search_runs_no_job(spark):
    docs = spark.createDataFrame(DOCS, "id long, name string, description string, category string, rating double")
    q = spark.createDataFrame([(1, "bolt")], "query_id long, query string")
    sc = spark.sparkContext
    sc.setJobGroup("search-build", "building only")
    try:
        hits = S.search(docs, q, "id")
        assert not sc.statusTracker().getJobIdsForGroup("search-build")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert hits.count() == 3


def test_a_hot_term_is_a_splittable_join_key(spark):
    """Postings need no exchange of their own, so the join's sides come straight from theirs."""
    docs = spark.createDataFrame([(i, "bolt " * 3 + f"w{i}") for i in range(50)], "id long, text string")
    terms = spark.createDataFrame([("bolt",)], "term string")
    post = S.postings(docs, "id", "text")
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    got = S.postings(docs, "id", "text", terms).collect()
    assert len(got) == 50 and all((r.term, r.tf, r.dl) == ("bolt", 3, 4) for r in got)
