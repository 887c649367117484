"""Relevance search as DataFrame jobs.

The source sends one ``multi_match`` query (fields name^3, description,
category^2, best_fields, OR of terms) with optional category/rating filters
to a search engine and keeps the best 100 hits. Here the index is a set of
DataFrames and a *batch* of queries is scored at once:

    tokenize   X1  lower-cased word tokens (letters/digits), whole text
    postings   X2  (doc, term, tf) + field length per doc, per field
    bm25       X3  idf(t) * tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl)), summed over
                   query terms (weighted by their count in the query)
    best_field X4  max over fields of boost * field score
    search     X5  + filters (P13) + top 100 per query (T6)

Keyword fields (category) match the whole query text exactly; their score is
idf only (no length norm), like an untokenized keyword field.

Scale: a document's term counts are worked out inside its row, so postings need
no shuffle; the batch's query terms with their document frequencies are broadcast to them (a
batch's texts must fit a task; the index may be any size), so a hot term is spread as its documents are, and
a document's parts are summed where it is; document frequencies are counted only for query terms. Index statistics are scalar subqueries: building a
search runs no job. The top-k per query uses ``row_number <= k``, which Spark turns
into a partial per-partition limit before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# BM25 parameters of the engine's default similarity.
K1, B = 1.2, 0.75
# Field boosts of the source query.
FIELD_BOOSTS = {"name": 3.0, "description": 1.0, "category": 2.0}
TOP_HITS = 100
MIN_QUERY_LEN = 2
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
SCORE_DECIMALS = 4


def tokenize(c) -> Column:
    """Array of lower-cased tokens of the whole text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SPLIT), lambda t: t != "")


def term_counts(docs: DataFrame, field: str, tag: str = "") -> tuple[DataFrame, Column, Column]:
    """``docs`` with the sorted tokens of one text field beside them; its (term, tf) pairs; its length.

    Counted in the row: in the sorted tokens a term is a run, and its tf the
    distance to the next run. The pairs are an expression to be exploded as it is: Spark would push
    its own filter on an exploded column below the tokens, and split the text again for each of them.
    """
    toks, dl, runs = f"_toks{tag}", f"_dl{tag}", f"_runs{tag}"
    rows = docs.withColumn(toks, F.sort_array(tokenize(field))).withColumn(dl, F.size(toks))
    at = F.sequence(F.lit(0), F.greatest(F.col(dl) - 1, F.lit(0)))
    rows = rows.withColumn(runs, F.filter(at, lambda i: (i < F.col(dl)) & ((i == 0) | (
        F.get(toks, i) != F.get(toks, F.greatest(i - 1, F.lit(0)))))))
    counts = F.transform(runs, lambda s, k: F.struct(F.get(toks, s).alias("term"), (
        F.coalesce(F.get(runs, k + 1), F.col(dl)) - s).cast("bigint").alias("tf")))
    return rows, counts, F.col(dl)


def postings(docs: DataFrame, id_col: str, field: str, terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, dl) for one text field. With ``terms`` (one ``term`` column) only those are kept."""
    rows, counts, dl = term_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(field).alias("_text")), "_text")
    post = rows.select("doc_id", dl.alias("dl"), F.explode(counts).alias("p")).select("doc_id", "p.term", "p.tf", "dl")
    return post if terms is None else post.join(terms, "term", "left_semi")


def query_terms(queries: DataFrame, qid: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, qtf) of each query's whole text."""
    t = queries.select(F.col(qid).alias("query_id"), F.explode(tokenize(text)).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _idf(n: Column, df: Column) -> Column:
    return F.ln(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def index_stats(docs: DataFrame, text_fields: Sequence[str]) -> dict:
    """N and average field length of each text field, as scalar subqueries.

    They share one aggregate over the documents (Spark merges them), run with the search.
    """
    n = F.count(F.lit(1))
    stats = docs.select(n.alias("n"), *[F.coalesce(F.try_divide(
        F.sum(F.size(tokenize(f))).cast("double"), n.cast("double")), F.lit(0.0)).alias(f"avg_{i}")
        for i, f in enumerate(text_fields)])
    return {"n": stats.select("n").scalar(),
            "avgdl": {f: stats.select(f"avg_{i}").scalar() for i, f in enumerate(text_fields)}}


def bm25_text_field(docs: DataFrame, id_col: str, field: str, qterms: DataFrame,
                    n_docs: Column, avgdl: Column, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) for one tokenized field.

    Postings are built only for documents' terms that occur in some query
    (semi-join on the query terms before the per-term aggregation). The query terms go to
    the postings, which stay with their documents: no posting is shuffled.
    """
    wanted = F.broadcast(qterms.select("term").distinct())
    post_q = postings(docs, id_col, field, wanted)
    df = post_q.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    m = post_q.join(F.broadcast(qterms.join(df, "term", "inner")), "term", "inner")
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = F.col("qtf") * _idf(n_docs, F.col("df")) * F.col("tf") * F.lit(k1 + 1) / norm
    return m.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def keyword_field(docs: DataFrame, id_col: str, field: str, queries: DataFrame, n_docs: Column,
                  qid: str = "query_id", text: str = "query") -> DataFrame:
    """Exact whole-value match on a keyword field, scored by idf."""
    vals = docs.select(F.col(id_col).alias("doc_id"), F.col(field).alias("value"))
    q = queries.select(F.col(qid).alias("query_id"), F.col(text).alias("value"))
    qv = q.select("value").distinct()
    df = vals.join(qv, "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("df"))
    m = q.join(df, "value", "inner").join(vals, "value", "inner")
    return m.select("query_id", "doc_id", _idf(n_docs, F.col("df")).alias("score"))


def best_fields(field_scores: dict[str, DataFrame], boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
    """Max over fields of boost x field score."""
    parts = [s.select("query_id", "doc_id", (F.col("score") * F.lit(boosts[f])).alias("score"))
             for f, s in field_scores.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def search(docs: DataFrame, queries: DataFrame, id_col: str = "id",
           text_fields: Sequence[str] = ("name", "description"), keyword_fields: Sequence[str] = ("category",),
           category: str | None = None, min_rating: float | None = None, k: int = TOP_HITS,
           boosts: dict[str, float] = FIELD_BOOSTS) -> DataFrame:
    """Best ``k`` documents per query with their source fields and score.

    queries: ``query_id``, ``query`` (texts shorter than 2 chars are rejected).
    Filters (P13): a falsy ``category``/``min_rating`` means no filter.
    """
    if min_rating is not None and not 0 <= min_rating <= 5:
        raise ValueError("min_rating must be within 0..5")
    q = queries.filter(F.length(F.trim("query")) >= MIN_QUERY_LEN)
    qt = query_terms(q)
    # statistics (N, avgdl, df) come from the whole index; filters only
    # restrict which documents may be returned, as in a filtered bool query
    st = index_stats(docs, text_fields)
    scores = {f: bm25_text_field(docs, id_col, f, qt, st["n"], st["avgdl"][f]) for f in text_fields}
    for f in keyword_fields:
        scores[f] = keyword_field(docs, id_col, f, q, st["n"])
    best = best_fields(scores, boosts).withColumn("score", F.round("score", SCORE_DECIMALS))
    keep = docs
    if category:
        keep = keep.filter(F.col("category") == category)
    if min_rating:
        keep = keep.filter(F.col("rating") >= F.lit(min_rating))
    if keep is not docs:
        best = best.join(keep.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    top = (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
           .withColumn("rank", F.col("rank").cast("bigint")))
    return top.join(docs.withColumnRenamed(id_col, "doc_id"), "doc_id", "inner").withColumnRenamed("doc_id", id_col)
