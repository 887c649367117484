"""Operator 12: URL verdicts by host and path rules, and by segmented hosts and naive Bayes.

1. The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
   lower-cased; the path goes on up to ``?``, ``#`` or the end. Of the rules that fit, the longest
   decides.
2. The words of all pages' texts are counted (partial sums in the tasks). They are the unigram
   model that splits a host's runs of letters: every piece of a run of up to
   ``LONGEST_WORD`` letters meets the vocabulary in an equi-join, and Viterbi picks the
   split of the largest probability. An unknown piece of n letters has probability
   10 / (N 10**n), so that a name of no known words stays whole. Only distinct runs are split.
   A run over ``LONGEST_LABEL`` letters is no DNS label and stays whole.
3. Multinomial naive Bayes with add-one smoothing learns from all urls that a rule decides,
   whose verdict is the class, and judges the others by the words of their host and the
   tokens of their path (runs of letters; a run of digits counts by its length). Token counts
   are kept in ``BUCKETS`` hashed counters, so the model has a fixed size (8 MB) whatever
   the number of tokens, and scoring needs no shuffle.

A host that a third of all pages share meets its one row of words in a join that adaptive
execution may split; counts are partial sums everywhere.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule fits,
and the classes' shares decide; a null html has no words; repeated rows are judged alike and
learned again; ties between rules of equal length go to the longer host, a score of zero is
``allow``; without learnable urls everything undecided is allowed; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable

LONGEST_WORD = 24
LONGEST_LABEL = 63
BUCKETS = 1 << 20
HELD_WORDS = 300_000

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUNS = r"\p{L}+|\p{Nd}+"
_DIGITS = r"^\p{Nd}"

Rule = tuple[str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return (F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _UPPER.lower()),
            F.regexp_extract(text, pattern, 2))


def deciding_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls. ``rules``: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for decides, text in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        at = text.index("/")
        fits = (F.concat(F.lit("."), host).endswith("." + text[:at])) & path.startswith(text[at:])
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decides)).otherwise(verdict)
    return rule, verdict


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    held: Counter = Counter()
    for pdf in batches:
        for html in pdf["html"]:
            if html is not None:
                held.update(w for w in _LETTERS.findall(_HIDDEN.sub(" ", html).lower()) if len(w) <= LONGEST_WORD)
        if len(held) > HELD_WORDS:
            yield frame()
            held.clear()
    yield frame()


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(word, n)``: how often each word stands in the pages' texts, tags and scripts left out."""
    html = pages.select(F.col(html_col).cast("string").alias("html"))
    return html.mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split_run(run: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable split of a run into words (Viterbi); of equal ones that with the longest last word."""
    log_total = math.log(max(total, 1))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        found = (-math.inf, 0)
        for at in range(end):
            n = known.get(run[at:end]) if end - at <= LONGEST_WORD else None
            p = math.log(n) - log_total if n else math.log(10) * (1 - (end - at)) - log_total
            if best[at][0] + p > found[0]:
                found = (best[at][0] + p, at)
        best.append(found)
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``(host, words)``: each of the distinct hosts with its segmented words, in order."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(_RUNS), F.lit(0))).alias("at", "run"))
    runs = durable(runs)
    names = durable(runs.where(~F.col("run").rlike(_DIGITS)).select("run").distinct())
    cut = names.where(F.char_length("run") <= LONGEST_LABEL)
    cut = cut.withColumn("start", F.explode(F.sequence(F.lit(1), F.char_length("run"))))
    most = F.least(F.lit(LONGEST_WORD), F.char_length("run") - F.col("start") + 1)
    cut = cut.withColumn("size", F.explode(F.sequence(F.lit(1), most)))
    pieces = cut.select("run", F.substring("run", F.col("start"), F.col("size")).alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    table = names.join(known, "run", "left")

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([[r] if len(r) > LONGEST_LABEL else
                          split_run(r, {k["word"]: k["n"] for k in found} if found is not None else {}, total)
                          for r, found in zip(run, known)], dtype=object)

    split_up = durable(table.select("run", split("run", "known").alias("words")))
    each = runs.join(split_up, "run", "left").select(
        "host", "at", F.coalesce("words", F.array(size_token(F.col("run")))).alias("words"))
    return each.groupBy("host").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"))


def size_token(digits: Column) -> Column:
    return F.concat(F.lit("#"), F.char_length(digits).cast("string"))


def path_tokens(path: Column) -> Column:
    runs = F.regexp_extract_all(F.lower(path), F.lit(_RUNS), F.lit(0))
    return F.transform(runs, lambda r: F.when(r.rlike(_DIGITS), size_token(r)).otherwise(r))


def buckets(words: Column, path: Column) -> Column:
    """The counters of a url's tokens; host words and path tokens are apart."""
    tokens = F.concat(F.transform(words, lambda w: F.concat(F.lit("h:"), w)),
                      F.transform(path_tokens(path), lambda w: F.concat(F.lit("p:"), w)))
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def fit_bayes(urls: DataFrame, block: Column) -> tuple[np.ndarray, float]:
    """Log ratios of the counters and of the classes, from ``urls`` (at: array of counters)."""
    one = F.when(block, 1).otherwise(0).cast("long")
    counts = (urls.select(F.explode("at").alias("at"), one.alias("blocked"))
              .groupBy("at").agg(F.sum("blocked").alias("b"), F.count("*").alias("n")).toPandas())
    n, b = urls.agg(F.count("*"), F.coalesce(F.sum(one), F.lit(0))).first()
    blocked, allowed = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["at"].to_numpy(dtype=np.int64)
    blocked[at] = counts["b"].to_numpy(dtype=np.int64)
    allowed[at] = (counts["n"] - counts["b"]).to_numpy(dtype=np.int64)
    kinds = max(1, len(at))
    weights = (np.log((blocked + 1) / (blocked.sum() + kinds)) - np.log((allowed + 1) / (allowed.sum() + kinds)))
    weights[np.setdiff1d(np.arange(BUCKETS), at)] = 0.0  # never seen: no evidence
    return weights, math.log((b + 1) / (n - b + 1))


def judge_urls(pages: DataFrame, rules: list[Rule], learn: Column | None = None, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, words, score)``, one row per page.

    ``words`` are the host's, ``score`` is the log ratio of block to allow. ``learn`` narrows the urls that
    are learned from (a condition over the columns of ``pages``), for held-out measurements.
    """
    host, path = host_and_path(F.col(url_col))
    told = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
                        (F.lit(True) if learn is None else learn).alias("learn"))
    rule, verdict = deciding_rule(rules, F.col("host"), F.col("path"))
    told = durable(told.withColumns({"rule": rule, "ruled": verdict}))
    named = durable(host_words(told.select("host").distinct(), durable(page_words(pages, html_col))))
    urls = durable(told.join(named, "host", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
                   .withColumn("at", buckets(F.col("words"), F.col("path"))))
    weights, prior = fit_bayes(urls.where("ruled is not null and learn"), F.col("ruled") == "block")
    model = pages.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(at: pd.Series) -> pd.Series:
        return pd.Series([prior + math.fsum(model.value[np.asarray(a, dtype=np.int64)]) for a in at], dtype="float64")

    return urls.withColumn("score", score("at")).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")
