"""Operator 1: exact deduplication by content-defined chunk recipes (native).

A text, with the six ASCII white-space characters deleted, is cut where its
content says so: a chunk ends at the first pair of boundary characters after
``MIN_CHUNK`` code points, at ``MAX_CHUNK`` at the latest. Each chunk becomes a
128-bit identifier, and a document becomes its ordered list of identifiers (its
recipe, about a twentieth of the text). Documents are compared and regrouped by
recipe only; text crosses the network once, as distinct chunks of bounded size,
to verify that no identifier stands for two different chunks. Should one ever,
the recipes are compared together with the SHA-256 of the whole text.

Skew: equal recipes collapse in the map-side aggregate. The groups are written before
they are joined back to their members, so both sides of that join are plain exchanges
and adaptive execution splits a hot group (with the aggregate in the join's own
stage it could not).

Defined results: a null text counts as empty and all empty texts are one group;
a null ``doc_id`` sorts after every other; rows that repeat a doc_id with an
equal text count as rows of the group and carry the same result; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_SPACE, durable, text_or_empty

MIN_CHUNK = 192
MAX_CHUNK = 1024
SECOND_SEED = 0x9E3779B97F4A7C


def boundary_class() -> str:
    """A regex class holding about one character in eight of every script.

    By rule: each fifth of eight letters and digits of ASCII, and the first 128
    code points of each block of 1,024 from U+0400 up to the surrogates.
    """
    ascii_part = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c).isalnum() and c % 8 == 5)
    wide = "".join(f"\\u{b:04X}-\\u{b + 0x7F:04X}" for b in range(0x0400, 0xD800, 0x0400))
    return f"[{ascii_part}{wide}]"


def chunk_pattern(lo: int = MIN_CHUNK, hi: int = MAX_CHUNK) -> str:
    b = boundary_class()
    return rf"(?s).{{{lo}}}.{{0,{hi - lo - 2}}}?(?:{b}{b}|\z)|.{{1,{hi}}}"


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    out = text_or_empty(text)
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column) -> Column:
    """The content-defined chunks, in order; none for an empty text."""
    return F.regexp_extract_all(norm, F.lit(chunk_pattern()), F.lit(0))


def identifier(chunk: Column) -> tuple[Column, Column]:
    return F.xxhash64(chunk), F.xxhash64(F.lit(SECOND_SEED), chunk)


def colliding_identifiers(norm: DataFrame, identify=identifier) -> DataFrame:
    """Identifiers that stand for more than one distinct chunk (normally none)."""
    one = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    hi, lo = identify(F.col("chunk"))
    distinct = one.select(hi.alias("hi"), lo.alias("lo"), "chunk").distinct()
    return distinct.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                identify=identifier) -> DataFrame:
    """One row per input row: the class of its text and whether it stays.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars, n_chunks``.
    Of equal texts the row with the most code points in the original text stays,
    then the smallest doc_id. ``identify`` maps a chunk to two hash columns (for tests).
    """
    norm = docs.select(F.col(id_col).alias("doc_id"),
                       F.char_length(text_or_empty(F.col(text_col))).alias("n_chars"),
                       normalised(F.col(text_col)).alias("norm"))
    recipe = F.flatten(F.transform(chunks(F.col("norm")), lambda c: F.array(*identify(c))))
    known = durable(norm.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
                                recipe.alias("recipe")))

    collisions = colliding_identifiers(norm, identify).agg(F.count("*").alias("n")).scalar()
    known = known.withColumn(
        "tie", F.when(collisions > 0, F.col("text_sha256")).otherwise(F.lit("")))

    first = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"),
                     F.col("doc_id").alias("c"))
    groups = durable(known.groupBy("recipe", "tie")
                     .agg(F.count("*").alias("group_size"), F.min_by("doc_id", first).alias("keep_id"))
                     .where("group_size > 1"))
    return known.join(groups, ["recipe", "tie"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        .alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256", F.col("n_chars").cast("long").alias("n_chars"),
        (F.size("recipe") / 2).cast("long").alias("n_chunks"))


def keep_first_of_equal(docs: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat a doc_id with an equal text and length, one stays.
    """
    key = ["__ed_sha", "__ed_n", "__ed_id", "__ed_null"]
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("text_sha256").alias(key[0]), F.col("n_chars").alias(key[1]),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key[2]),
        F.col("doc_id").isNull().alias(key[3])).distinct()
    keyed = docs.withColumns({
        key[0]: F.sha2(normalised(F.col(text_col)), 256),
        key[1]: F.char_length(text_or_empty(F.col(text_col))).cast("long"),
        key[2]: F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        key[3]: F.col(id_col).isNull()})
    return keyed.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)
