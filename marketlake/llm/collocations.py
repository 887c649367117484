"""Operator 11: phrase collocations counted in quotient filters.

1. A word's id is a 64-bit hash of (lang, word), verified over all distinct words: no two
   words share one, else the next seed is taken. So tasks number words without a
   dictionary, and the id table gives the words back at the end.
2. Phrases are counted level by level, 2 to ``LONGEST`` words. A phrase of k words is the
   pair of its first and its last k - 1 words' ids, packed into 128 bits: for either
   half given, the other's words follow, so equal pairs are equal phrases (but for two
   64-bit hashes that coincide at once). A phrase can only reach ``least`` if both halves do,
   which a bitmap of fixed size (8 MB) tells the tasks; what it wrongly lets through is
   counted and found too rare.
3. Each task counts into lossless counting quotient filters (``quotient_filter``), one a
   shard of the permuted keys; the sorted filters of a shard are merged in one task,
   and the phrases of ``least`` occurrences are decoded from quotient and remainder. The
   number of shards follows the number of words, so a shard's size stays the same.
4. Counts of the parts, scores and containment are equi-joins on ids over the frequent
   phrases alone. A phrase that lies in a longer one lies in one that is a single word longer
   and at least as frequent as that, so containment looks one level up.

A phrase that fills a third of all texts is one key a task and filter.

Defined results: null and empty texts have no words; a null lang counts as ``und``; repeated
rows count again; a null doc_id matters nowhere; words and texts of any length take part; ties
by phrase in UTF-8 byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, release, text_or_empty
from .quotient_filter import Counts, by_shard, collapse, merge, permute, restore, unpack
from .shingles import mix, run_hashes

LEAST = 30
LONGEST = 4
TOP = 2000
KEPT_SHARE = 80
SCALE = 2_000_000
CHUNK_BYTES = 1 << 19
HELD_WORDS = 200_000
HELD_KEYS = 1 << 19
SHARD_WORDS = 1 << 21
BITMAP_BITS = 26

_U = np.uint64
BLANK, PIECE_END = 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = PIECE_END


class Words:
    """The words of a chunk of texts: ids, pieces, and where they stand."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int):
        self.data = b"\n".join(texts)
        b = np.frombuffer(self.data, dtype=np.uint8)
        kind = _KIND[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], kind > 0, [True])).view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.cumsum(kind == PIECE_END, dtype=np.int32)[self.starts]
        self.of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.starts, side="right")
        of_lang = {x: lang_seed(x, seed) for x in set(langs)}
        seeds = np.array([of_lang[x] for x in langs], dtype=_U)
        self.ids = mix(run_hashes(b, self.starts, self.ends, seed) ^ seeds[self.of])

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].lower().decode("utf-8", "replace")


def lang_seed(lang: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=seed)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The id of the phrase whose first and last part have ids x and y; one to one in each of them."""
    return mix(mix(x + _U(0xA0761D6478BD642F)) ^ (y * _U(0xE7037ED1A0B428DB) + _U(0x8EBC6AF09C88C6E3)))


def chunks(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[tuple[Words, list[str]]]:
    texts, langs, size = [], [], 0
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            texts.append(bytes(text))
            langs.append(lang)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield Words(texts, langs, seed), langs
                texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs, seed), langs


def _worded(seed: int):
    def worded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def frame() -> pd.DataFrame:
            rows = [(i, *v) for i, v in held.items()]
            cols = list(zip(*rows)) if rows else [()] * 4
            return pd.DataFrame({"id": np.array(cols[0], dtype=_U).view(np.int64), "lang": pd.Series(cols[1], dtype=object),
                                 "word": pd.Series(cols[2], dtype=object), "f": pd.Series(cols[3], dtype="int64")})

        for words, langs in chunks(batches, seed):
            ids, first, n = np.unique(words.ids, return_index=True, return_counts=True)
            for i, at, k in zip(ids.tolist(), first.tolist(), n.tolist()):
                if i in held:
                    held[i][2] += k
                else:
                    held[i] = [langs[words.of[at]], words.word(at), k]
            if len(held) > HELD_WORDS:
                yield frame()
                held.clear()
        yield frame()
    return worded


def _filtered(level: int, seed: int, shard_bits: int, bitmaps: list):
    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = [b.value for b in bitmaps]
        runs: list[Counts] = []
        raw: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settled() -> None:
            hi, lo = (np.concatenate(part) for part in zip(*raw))
            runs.append(collapse(hi, lo, np.ones(len(hi), dtype=np.int64)))
            raw.clear()

        def frame() -> pd.DataFrame:
            out = list(by_shard(merge(runs), shard_bits)) if runs else []
            runs.clear()
            return pd.DataFrame({"shard": pd.Series([s for s, _ in out], dtype="int32"),
                                 "filter": pd.Series([f for _, f in out], dtype=object)})

        for words, _ in chunks(batches, seed):
            x, y = halves(words, level, common)
            if not len(x):
                continue
            raw.append(permute(x, y))
            waiting += len(x)
            if waiting > HELD_KEYS:
                settled()
                waiting = 0
                if sum(len(r[0]) for r in runs) > 2 * HELD_KEYS:
                    runs[:] = [merge(runs)]
                    if len(runs[0][0]) > HELD_KEYS:
                        yield frame()
        if raw:
            settled()
        yield frame()
    return filtered


def halves(words: Words, level: int, common: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the first and last ``level`` - 1 words of each run of ``level`` words of one
    piece whose parts are all common so far."""
    ids, piece = words.ids, words.piece
    at = np.arange(len(ids))
    for k in range(1, level):
        fine = has(common[k - 1], ids)
        both = np.flatnonzero(fine[:-1] & fine[1:] & (at[1:] == at[:-1] + 1) & (piece[1:] == piece[:-1]))
        x, y = ids[both], ids[both + 1]
        if k == level - 1:
            return x, y
        ids, piece, at = joined(x, y), piece[both], at[both]
    raise ValueError("a phrase has two words at least")


def has(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & _U(len(bitmap) * 64 - 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """A bit for each id of ``phrases`` modulo 2**BITMAP_BITS: of fixed size, whatever the input."""
    at = phrases.select(F.col("id").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(_U)


def _merged(least: int):
    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        hi, lo, n = merge([unpack(bytes(f), shard) for f in pdf["filter"]])
        x, y = restore(hi[n >= least], lo[n >= least])
        return pd.DataFrame({"x": x.view(np.int64), "y": y.view(np.int64), "id": joined(x, y).view(np.int64),
                             "f": n[n >= least]})
    return merged


def collides(ids: DataFrame) -> bool:
    return bool(ids.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count())


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang",
                     text_col: str = "text", seed: int = 1) -> tuple[list[DataFrame], DataFrame]:
    """The phrases of ``least`` occurrences, one frame for each number of words, and ``(lang, n)``.

    Columns: ``id, lang, phrase, f`` (occurrences); ``l`` and ``r``, arrays of the occurrences of what
    stands before and after each cut; ``x`` and ``y``, the ids of the phrase without its last
    and without its first word (none for single words).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       text_or_empty(F.col(text_col)).cast("binary").alias("text"))
    while True:
        words = durable(rows.mapInPandas(_worded(seed), "id long, lang string, word string, f long")
                        .groupBy("id", "lang", "word").agg(F.sum("f").alias("f")))
        if not collides(words):
            break
        seed += 1
    totals = durable(words.groupBy("lang").agg(F.sum("f").alias("n")))
    spoken = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shard_bits = min(30, max(0, -(-spoken // SHARD_WORDS) - 1).bit_length())
    none = F.array().cast("array<long>")
    levels = [durable(words.where(F.col("f") >= least).select(
        "id", "lang", F.col("word").alias("phrase"), "f", none.alias("l"), none.alias("r"),
        F.col("word").alias("last_word"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y")))]
    bitmaps = []
    for level in range(2, longest + 1):
        release(spark)
        bitmaps.append(spark.sparkContext.broadcast(bitmap_of(levels[-1])))
        filters = rows.mapInPandas(_filtered(level, seed, shard_bits, bitmaps), "shard int, filter binary")
        pairs = filters.groupBy("shard").applyInPandas(_merged(least), "x long, y long, id long, f long")
        levels.append(durable(parts(durable(pairs), levels[-1], level)))
        if level < longest and collides(levels[-1]):
            return frequent_phrases(docs, least, longest, lang_col, text_col, seed + 1)
    return levels, totals


def parts(pairs: DataFrame, shorter: DataFrame, level: int) -> DataFrame:
    """The phrases of the pairs (x, y) of shorter ones, with the counts at each of their cuts."""
    names = ["id", "lang", "phrase", "f", "l", "r", "last_word", "x", "y"]
    a = shorter.select(*(F.col(c).alias(f"a_{c}") for c in names))
    b = shorter.select(*(F.col(c).alias(f"b_{c}") for c in names))
    both = pairs.join(a, F.col("x") == F.col("a_id")).join(b, F.col("y") == F.col("b_id"))
    if level > 2:  # the halves overlap in the same words
        both = both.where(F.col("a_y") == F.col("b_x"))
    both = both.where(F.col("a_lang") == F.col("b_lang"))
    return both.select(
        "id", F.col("a_lang").alias("lang"), F.concat_ws(" ", "a_phrase", "b_last_word").alias("phrase"), "f",
        F.array_append("a_l", F.col("a_f")).alias("l"), F.array_prepend("b_r", F.col("b_f")).alias("r"),
        F.col("b_last_word").alias("last_word"), "x", "y")


def whole(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP,
                 kept_share: int = KEPT_SHARE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score, words)``: each lang's first ``top`` phrases by score.

    The score of a cut is floor(2,000,000 a / (l + r)), l and r the occurrences of what stands before
    and after it; the lowest-scoring cut counts, then the first. A phrase goes if a longer one that holds
    it has ``kept_share`` hundredths of its occurrences or more.
    """
    levels, totals = frequent_phrases(docs, least, longest, lang_col, text_col)
    out = []
    for k, phrases in enumerate(levels[1:], start=2):
        cuts = F.transform(F.arrays_zip("l", "r"), lambda c, i: F.struct(
            score(F.col("f"), c["l"], c["r"]).alias("score"), i.alias("cut"), c["l"].alias("l"), c["r"].alias("r")))
        found = phrases.select("id", "lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
        if k < len(levels):
            longer = levels[k]
            held = (longer.select(F.col("x").alias("of"), "f").union(longer.select("y", "f"))
                    .groupBy("of").agg(F.max("f").alias("f")))
            found = found.join(held, F.col("id") == F.col("of"), "left").where(
                F.col("f").isNull() | (100 * whole(F.col("f")) < kept_share * whole(F.col("a"))))
        out.append(found.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                                F.col("cut.score").alias("score"), F.lit(k).alias("words")))
    ranked = out[0]
    for more in out[1:]:
        ranked = ranked.union(more)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")


def score(a: Column, l: Column, r: Column) -> Column:
    """Exact for all counts: products and sums in decimals of 38 digits."""
    up = F.lit(SCALE).cast("decimal(7,0)") * whole(a)
    return F.call_function("div", up, whole(l) + whole(r))
