"""The corpus pipeline: quality filter, dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function) in order; every function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet
into the shared folder and reads again as the next stage's documents. All but the
last return the columns of ``documents`` (and any further ones that came in).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlake.llm.common import durable, fold, table
from marketlake.llm.exact_dedup import keep_first_of_equal
from marketlake.llm.mixing import write_mix
from marketlake.llm.near_jaccard import keep_one_per_component
from marketlake.llm.packing import added_tokens, pack_documents
from marketlake.llm.quality import fit_quality, score_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents the classifier scores under 0.5 go.

    Learns from labelled rows of these documents outside the evaluation fold.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, model, out="__kq_score")
    return scored.where(F.col("__kq_score") >= 0.5).drop("__kq_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts one document stays."""
    return keep_first_of_equal(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are repeated or left out to meet their source's target."""
    return write_mix(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near duplicates one document stays."""
    return keep_one_per_component(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of the packed sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                          added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", keep_one_of_near),
    ("mix_sources", mix),
    ("packing", pack),
]

# The classifier, and packing by a trained tokenizer's ids, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
