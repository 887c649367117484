"""Operator 13: spelling variants by reduced-alphabet neighbourhoods.

1. Words are counted inside the tasks (one partial sum a task and word reaches the
   shuffle), so a word that fills a third of all texts is a handful of rows.
2. Letters are hashed to ``SYMBOLS`` symbols. Words one edit apart have reduced words at
   most one edit apart, so the full one-edit neighbourhood of a reduced word holds the
   reduced words of all its near words, and is much smaller than that over all letters.
   A pair is generated from one end only: the longer word by its deletions (they are the
   shorter word's insertions), of two equally long ones that with the smaller symbol
   at the replaced place, or the smaller word where the reduced words are equal.
3. The neighbourhoods meet the reduced vocabulary in an equi-join on a 64-bit hash of the
   reduced word. The join itself verifies the original strings, so no pair leaves it
   but the near ones. Words over ``CARRIED`` letters, whose neighbourhoods times their length
   would grow with the square, meet by number and are verified after.
4. A word's form is a maximum over its near words; roots follow by pointer jumping. A form
   is at least twice as frequent as its word, so chains have 63 links at most, which
   seven rounds double over.

Neighbourhoods grow with a word's length times ``SYMBOLS``, candidates with the number of
words that share a reduced word; more symbols trade the second for the first.

Defined results: null and empty texts have no words; a null doc_id counts as the empty
text; repeated rows count again; words of any length take part; ties between near words
of equal count go to the smallest in code-point order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import durable, release, text_or_empty, with_text_id
from .shingles import mix

SYMBOLS = 8
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
HELD_WORDS = 300_000
CHUNK_LETTERS = 1 << 17
CARRIED = 64

_RUN = re.compile("[a-zÀ-ÿ]+")
_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP, _BACK = _U(_P), _U(pow(_P, -1, 1 << 64))


def runs_of(text: str) -> list[str]:
    """The maximal runs of letters, A-Z lower-cased and no other."""
    return _RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def with_typo(run: str, doc_start: int, every: int) -> str:
    """The run as its document spells it: where ``every`` divides the crc32, one letter is lost."""
    h = zlib.crc32(run.encode(), doc_start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(least: int, every: int | None):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if every:
                        run = with_typo(run, start, every)
                    if len(run) >= least:
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield _frame(held)
                    held = {}
        yield _frame(held)
    return counted


def _frame(held: dict[str, int]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all words of ``least`` letters and ``least_count`` occurrences.

    ``typo_every`` plants typing errors by the crc32 of ``<doc_id>:<run>`` (None: none).
    """
    rows, _ = with_text_id(docs, id_col, text_or_empty(F.col(text_col)))
    parts = rows.mapInPandas(_counted(least, typo_every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduced_keys(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word number, key, same)``: each word's reduced word (same) and the neighbours it looks up."""
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    of = np.repeat(np.arange(len(words)), sizes)
    symbol = ((c * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64) % symbols
    power = np.cumprod(np.concatenate(([_U(1)], np.full(max(sizes, default=1), _STEP, dtype=_U))), dtype=_U)
    power = power[np.arange(len(c)) - starts[of]]
    term = (symbol + 1).astype(_U) * power
    upto = np.concatenate(([_U(0)], np.cumsum(term, dtype=_U)))
    whole = upto[ends] - upto[starts]

    def key(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(h + n.astype(_U) * _U(0xD1342543DE82EF95))

    out = [(np.arange(len(words)), key(whole, sizes), True)]
    at = np.flatnonzero((np.arange(len(c)) == starts[of]) | (symbol != np.roll(symbol, 1)))
    before = upto[at] - upto[starts[of[at]]]
    out.append((of[at], key(before + (whole[of[at]] - before - term[at]) * _BACK, sizes[of[at]] - 1), False))
    for y in range(1, symbols):
        at = np.flatnonzero(symbol < y)
        moved = whole[of[at]] + (y - symbol[at]).astype(_U) * power[at]
        out.append((of[at], key(moved, sizes[of[at]]), False))
    return (np.concatenate([o for o, _, _ in out]), np.concatenate([k for _, k, _ in out]).view(np.int64),
            np.concatenate([np.full(len(o), s) for o, _, s in out]))


def _neighbours(symbols: int, own: bool):
    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["word"].str.len().cumsum() // CHUNK_LETTERS):
                of, key, same = reduced_keys(part["word"].tolist(), symbols)
                if own:
                    of, key, same = of[same], key[same], same[same]
                carried = part["word"].where(part["word"].str.len() <= CARRIED, None)
                yield pd.DataFrame({"key": key, "id": part["id"].to_numpy()[of], "word": carried.to_numpy()[of],
                                    "n": part["n"].to_numpy()[of], "same": same})
    return neighbours


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(a, n_a, b, n_b)``, each pair of ``words`` (id, word, n) exactly one edit apart once."""
    kinds = "key long, id long, word string, n long, same boolean"
    dealt = words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word")
    probe = dealt.mapInPandas(_neighbours(symbols, False), kinds).alias("p")
    index = dealt.mapInPandas(_neighbours(symbols, True), kinds).alias("i")
    near = F.levenshtein("p.word", "i.word", 1) == 1
    meet = (F.col("p.key") == F.col("i.key")) & (~F.col("p.same") | (F.col("p.id") < F.col("i.id")))
    found = durable(probe.join(index, meet & F.coalesce(near, F.lit(True))).select(
        F.col("p.id").alias("id_a"), F.col("p.word").alias("a"), F.col("p.n").alias("n_a"),
        F.col("i.id").alias("id_b"), F.col("i.word").alias("b"), F.col("i.n").alias("n_b")))
    carried = F.col("a").isNotNull() & F.col("b").isNotNull()
    names = ["a", "n_a", "b", "n_b"]
    long = (found.where(~carried).select("id_a", "n_a", "id_b", "n_b")
            .join(words.select(F.col("id").alias("id_a"), F.col("word").alias("a")), "id_a")
            .join(words.select(F.col("id").alias("id_b"), F.col("word").alias("b")), "id_b"))
    return found.where(carried).select(names).union(long.where(F.levenshtein("a", "b", 1) == 1).select(names))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word that has a form, by pointer jumping."""
    hops = durable(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = hops.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = durable(hops.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        hops = step.select("word", "root")
        if not moved:
            return hops


def spelling_variants(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``words`` (word, n; words distinct).

    A word's form is its near word of the largest n, if that is ``ratio`` times its own at least.
    """
    words = durable(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    release(words.sparkSession)
    pairs = near_words(words, symbols)
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("best"))))
    best = (pairs.select(ends.alias("e")).select("e.*").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min("best").alias("best")))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    forms = durable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    release(words.sparkSession)
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
