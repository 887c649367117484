"""Registered search queries.

* ``search_products``: the source's product search over the catalog's
  search documents (U14), one query text.
* ``search_corpus``: the same scorer over the ``documents`` table (name =
  first line, description = whole text, category = source) with every
  ``benchmark`` passage (whole text) as a query.
* ``term_statistics``: X2 postings statistics of the documents' text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as CAT
from ..operators import postings as P
from ..operators import search as S
from ..session import ensure_checkpoint_dir
from ..sources.catalog import ORACLE_CATALOG_CTES, Catalog
from ..sources.testdata import Star

# The product search request of the registered query.
PRODUCT_QUERY = "blue bolt"
PRODUCT_MIN_RATING = 4.0


def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 over product documents: 'blue bolt', rating >= 4, best 100."""
    c = Catalog(Star(spark, sf_dir))
    docs = CAT.search_document(c.products(), c.variants(), c.media(), constants=True)
    q = spark.range(1).select(F.lit(1).cast("bigint").alias("query_id"), F.lit(PRODUCT_QUERY).alias("query"))
    hits = S.search(docs, q, "id", min_rating=PRODUCT_MIN_RATING)
    return hits.select("query_id", "id", "name", "category", "price", "score", "rank")


# The filtered product search of the registered query.
FILTERED_QUERY, FILTERED_CATEGORY, FILTERED_MIN_RATING = "small gear", "MEDIUM", 2.5


def search_products_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real rating and category, category + rating filters."""
    c = Catalog(Star(spark, sf_dir))
    docs = CAT.search_document(c.products(), c.variants(), c.media(), constants=False)
    q = spark.range(1).select(F.lit(1).cast("bigint").alias("query_id"), F.lit(FILTERED_QUERY).alias("query"))
    hits = S.search(docs, q, "id", category=FILTERED_CATEGORY, min_rating=FILTERED_MIN_RATING)
    return hits.select("query_id", "id", "name", "category", "rating", "score", "rank")


def corpus_docs(star: Star) -> DataFrame:
    # a number of partitions of its own, so that none are merged: a document's score rows are many times its text
    d = star.raw("documents")
    d = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring_index(F.col("text"), "\n", 1).alias("name"),
        F.col("text").alias("description"),
        F.col("source").alias("category"),
    )


def search_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 batch: every benchmark passage against the documents, best 100 each."""
    star = Star(spark, sf_dir)
    q = star.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = S.search(corpus_docs(star), q, "id")
    return hits.select("query_id", "id", "category", "score", "rank")


def _stored_index(docs: DataFrame, **fields) -> P.PostingIndex:
    """The documents' postings with block maxima, written to the shared folder."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/postings-{uuid.uuid4().hex}"
    return P.build(docs, path, "id", **fields)


def search_corpus_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_corpus`` from stored postings, skipping blocks under the current k-th score."""
    star = Star(spark, sf_dir)
    docs = corpus_docs(star)
    q = star.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = _stored_index(docs).search(q)
    return hits.join(docs.select(F.col("id").alias("doc_id"), "category"), "doc_id").select(
        "query_id", F.col("doc_id").alias("id"), "category", "score", "rank")


def search_products_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_products_filtered`` from stored postings; the filters hold for the threshold too."""
    c = Catalog(Star(spark, sf_dir))
    docs = CAT.search_document(c.products(), c.variants(), c.media(), constants=False)
    q = spark.range(1).select(F.lit(1).cast("bigint").alias("query_id"), F.lit(FILTERED_QUERY).alias("query"))
    keep = docs.where((F.col("category") == FILTERED_CATEGORY) & (F.col("rating") >= FILTERED_MIN_RATING))
    hits = _stored_index(docs).search(q, keep=keep.select(F.col("id").alias("doc_id")))
    return hits.join(docs.select(F.col("id").alias("doc_id"), "name", "category", "rating"), "doc_id").select(
        "query_id", F.col("doc_id").alias("id"), "name", "category", "rating", "score", "rank")


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and collection frequency of every text term."""
    post = S.postings(corpus_docs(Star(spark, sf_dir)), "id", "description")
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


SEARCH_QUERIES = {
    "search_products": search_products,
    "search_products_filtered": search_products_filtered,
    "search_corpus": search_corpus,
    "term_statistics": term_statistics,
    "search_corpus_blocks": search_corpus_blocks,
    "search_products_blocks": search_products_blocks,
}

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _bm25_sql(docs_cte: str, queries_cte: str, text_fields, keyword_fields, top: int,
              keep: str = "TRUE") -> str:
    parts = []
    for f in text_fields:
        boost = S.FIELD_BOOSTS[f]
        parts.append(f"""
  tk_{f} AS (SELECT id, {_TOK.format(c=f)} AS toks FROM docs),
  st_{f} AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk_{f}),
  p_{f} AS (SELECT id AS doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
              SELECT id, len(toks) AS dl, unnest(toks) AS term FROM tk_{f})
            GROUP BY id, term),
  s_{f} AS (SELECT qt.query_id, p.doc_id,
                   CAST({boost} AS DOUBLE) * sum(qt.qtf * ln(1.0 + (st.n - df.df + 0.5) / (df.df + 0.5))
                             * p.tf * CAST({S.K1 + 1} AS DOUBLE)
                             / (p.tf + CAST({S.K1} AS DOUBLE) * (CAST({1 - S.B} AS DOUBLE)
                                + CAST({S.B} AS DOUBLE) * p.dl / st.avgdl))) AS score
            FROM qt JOIN (SELECT term, count(*) AS df FROM p_{f} WHERE term IN (SELECT term FROM qt) GROUP BY term) df
                 USING (term)
            JOIN p_{f} p USING (term), st_{f} st
            GROUP BY qt.query_id, p.doc_id)""")
    for f in keyword_fields:
        boost = S.FIELD_BOOSTS[f]
        parts.append(f"""
  s_{f} AS (SELECT q.query_id, docs.id AS doc_id,
                   CAST({boost} AS DOUBLE) * ln(1.0 + ((SELECT count(*) FROM docs) - df.df + 0.5) / (df.df + 0.5))
                     AS score
            FROM q JOIN (SELECT {f} AS value, count(*) AS df FROM docs GROUP BY 1) df ON df.value = q.query
            JOIN docs ON docs.{f} = q.query)""")
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, score FROM s_{f}" for f in [*text_fields, *keyword_fields])
    return f"""WITH {docs_cte},
  {queries_cte},
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (
           SELECT query_id, unnest({_TOK.format(c='query')}) AS term FROM q) GROUP BY 1, 2),
  {",".join(parts)},
  best AS (SELECT query_id, doc_id, round(max(score), {S.SCORE_DECIMALS}) AS score FROM ({union})
           GROUP BY 1, 2),
  kept AS (SELECT best.* FROM best JOIN docs ON docs.id = best.doc_id WHERE {keep}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept)
SELECT ranked.*, docs.* FROM ranked JOIN docs ON docs.id = ranked.doc_id WHERE rank <= {top}"""


_PRODUCT_DOCS = f"""{ORACLE_CATALOG_CTES.rstrip()},
  docs0 AS (SELECT cp.product_id AS id, cp.product_name AS name, cp.description,
                   coalesce(CAST(v.price AS DOUBLE), 0.0) AS price, CAST(4.5 AS DOUBLE) AS rating,
                   'general' AS category
            FROM cp LEFT JOIN (SELECT product_id, arg_min(price, variant_id) AS price FROM cvar GROUP BY 1) v
                 USING (product_id)),
  docs AS (SELECT * FROM docs0)"""

_PRODUCT_DOCS_REAL = f"""{ORACLE_CATALOG_CTES.rstrip()},
  docs AS (SELECT cp.product_id AS id, cp.product_name AS name, cp.description,
                  CAST(cp.external_ratings AS DOUBLE) AS rating, cp.main_category AS category
           FROM cp)"""

_CORPUS_DOCS = """docs AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS name, text AS description,
                   source AS category FROM documents)"""

SEARCH_SQL = {
    "search_products": f"""SELECT query_id, id, name, category, price, score, rank FROM (
{_bm25_sql(_PRODUCT_DOCS, "q AS (SELECT CAST(1 AS BIGINT) AS query_id, '" + PRODUCT_QUERY + "' AS query)",
           ["name", "description"], ["category"], S.TOP_HITS, f"docs.rating >= {PRODUCT_MIN_RATING}")})""",
    "search_products_filtered": f"""SELECT query_id, id, name, category, rating, score, rank FROM (
{_bm25_sql(_PRODUCT_DOCS_REAL, "q AS (SELECT CAST(1 AS BIGINT) AS query_id, '" + FILTERED_QUERY + "' AS query)",
           ["name", "description"], ["category"], S.TOP_HITS,
           f"docs.category = '{FILTERED_CATEGORY}' AND docs.rating >= {FILTERED_MIN_RATING}")})""",
    "search_corpus": f"""SELECT query_id, id, category, score, rank FROM (
{_bm25_sql(_CORPUS_DOCS, "q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE length(trim(text)) >= 2)",
           ["name", "description"], ["category"], S.TOP_HITS)})""",
    "term_statistics": f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest({_TOK.format(c='text')}) AS term FROM documents) GROUP BY 1, 2)
GROUP BY term""",
}

SEARCH_SQL["search_corpus_blocks"] = SEARCH_SQL["search_corpus"]  # the exhaustive search finds the same hits
SEARCH_SQL["search_products_blocks"] = SEARCH_SQL["search_products_filtered"]
