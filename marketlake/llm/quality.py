"""Operator 7: quality classifier: naive Bayes support vectors.

Every n-gram view of a text (character 1- to 3-grams, shapes of words and of
neighbouring words, repeated lines and word pairs) is hashed into ``2**HASH_BITS``
indicators. An indicator is scaled by the log ratio of its smoothed frequency in
the two classes, and a linear model with squared-free (L1) hinge loss is fitted on
the scaled indicators by dual coordinate descent. A logistic curve, fitted on
held-back rows of the sample, turns margins into scores.

Sample: at most ``max_labelled`` labelled rows (default 6,000), drawn by a seeded
hash of the id, half of them reserved for either class as far as there are rows;
the fit runs in one task over that bounded sample. Scoring streams over all
documents, whole texts, without a shuffle; only the model (``2**HASH_BITS`` floats)
is sent to tasks.

Defined results: a null text counts as empty and scores what an empty text scores;
labels that are null or contradict each other for one id are not learned from;
repeated rows score alike; if the sample lacks a class, the score is the smoothed
share of class 1 for every text (0.5 without labels); an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty

HASH_BITS = 18
MAX_LABELLED = 6000
SLICE = 1 << 20

_U = np.uint64


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + _U(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return (x >> _U(64 - HASH_BITS)).astype(np.int64)


def _shapes() -> np.ndarray:
    """Byte -> class: 0 space, 1 line end, 2 lower, 3 upper, 4 digit, 5 beyond ASCII, else its own."""
    t = np.arange(256, dtype=np.uint8)
    t[[9, 11, 12, 13, 32]] = 0
    t[10] = 1
    t[97:123] = 2
    t[65:91] = 3
    t[48:58] = 4
    t[128:] = 5
    return t


_SHAPE = _shapes()


def indicators(text: str) -> np.ndarray:
    """The sorted distinct feature numbers of a text."""
    data = text.encode("utf-8", "replace")
    on = np.zeros(1 << HASH_BITS, dtype=bool)
    for start in range(0, len(data), SLICE):  # slices overlap by the longest n-gram
        b = np.frombuffer(data[start:start + SLICE + 16], dtype=np.uint8)
        low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(_U)
        on[_mixed(low, 1)] = True
        if len(b) > 1:
            two = low[:-1] << _U(8) | low[1:]
            on[_mixed(two, 2)] = True
        if len(b) > 2:
            on[_mixed(two[:-1] << _U(8) | low[2:], 3)] = True
        shape = _SHAPE[b]
        keep = np.ones(len(b), dtype=bool)
        keep[1:] = shape[1:] != shape[:-1]
        s = shape[keep].astype(_U)  # runs collapsed: a word is one or two codes
        for k in (1, 2, 3, 4, 5):
            if len(s) >= k:
                code = s[:len(s) - k + 1].copy()
                for j in range(1, k):
                    code = code << _U(8) | s[j:len(s) - k + 1 + j]
                on[_mixed(code, 10 + k)] = True
    on[_mixed(_repetition(data), 20)] = True
    return np.flatnonzero(on)


def _repetition(data: bytes) -> np.ndarray:
    """Codes of how much of the text repeats: neighbouring words, words and lines."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x]
    n = len(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    level = lambda part, whole: min(9, int(10 * part / whole)) if whole else 10
    return np.array([100 + level(same, n - 1 if n > 1 else 0),
                     200 + level(len(set(words)), n) + (20 if n < 20 else 0),
                     300 + level(len(set(lines)), len(lines)),
                     400 + min(20, n.bit_length())], dtype=_U)


def fit_nbsvm(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12,
              alpha: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights per feature number, the bias and the ratios. ``y`` holds +1 and -1."""
    size = 1 << HASH_BITS
    pos, neg = np.full(size, alpha), np.full(size, alpha)
    for r, t in zip(rows, y):
        (pos if t > 0 else neg)[r] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[(pos == alpha) & (neg == alpha)] = 0
    # unit-length rows; the bias is a constant feature
    values = [ratio[r] / max(1e-9, np.sqrt((ratio[r] ** 2).sum())) for r in rows]
    w, bias = np.zeros(size), 0.0
    weight = {1: len(y) / (2 * max(1, (y > 0).sum())), -1: len(y) / (2 * max(1, (y < 0).sum()))}
    dual = np.zeros(len(rows))
    order = np.random.RandomState(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v, t = rows[i], values[i], y[i]
            gradient = t * (w[r] @ v + bias) - 1
            new = min(max(dual[i] - gradient / 2.0, 0.0), cost * weight[int(t)])
            if new != dual[i]:
                step = (new - dual[i]) * t
                w[r] += step * v
                bias += step
                dual[i] = new
    return (w * ratio).astype(np.float32), float(bias), ratio.astype(np.float32)


def _margin(r: np.ndarray, w: np.ndarray, ratio: np.ndarray, bias: float) -> float:
    return float(w[r].sum() / max(1e-9, np.sqrt((ratio[r].astype(np.float64) ** 2).sum())) + bias)


def _curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve by Newton steps, with his smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 4.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 4), (p - t).sum() + 1e-3 * b])
        q = p * (1 - p)
        h = np.array([[(q * margins ** 2).sum() + 1e-3, (q * margins).sum()],
                      [(q * margins).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of the bounded sample as one row."""
    pdf = pdf.sort_values(["draw", "doc_id"], kind="stable")
    y = np.where(pdf["label"].to_numpy() == 1, 1, -1)
    rows = [indicators(t) for t in pdf["text"]]
    part = np.arange(len(y)) % 4 == 0
    learn, hold = np.flatnonzero(~part), np.flatnonzero(part)
    w, bias, ratio = fit_nbsvm([rows[i] for i in learn], y[learn])
    a, b = _curve(np.array([_margin(rows[i], w, ratio, bias) for i in hold]), y[hold])
    return pd.DataFrame({"w": [w.tobytes()], "ratio": [ratio.tobytes()], "bias": [bias], "a": [a], "b": [b]})


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``bound`` labelled texts, either class up to half: ``doc_id, text, label, draw``.

    ``learn`` is a condition on the labels table's ``doc_id``. Ids and labels are
    drawn first; the broadcast side has at most ``bound`` rows of three numbers. Of rows that
    share a drawn id one is taken (smallest text hash), so the bound holds for rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & learn & F.col(label_col).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
    known = known.where("lo = hi").select(
        F.col("doc_id").alias("labelled"), F.col("lo").cast("int").alias("label"),
        F.xxhash64(F.lit(7), "doc_id").alias("draw"))
    half = bound // 2
    drawn = known.where("label = 0").orderBy("draw", "labelled").limit(half).union(
        known.where("label = 1").orderBy("draw", "labelled").limit(half))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    found = rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.char_length("text"))).alias("text")
    return found.groupBy("doc_id", "label", "draw").agg(one).select("doc_id", "text", "label", "draw")


def fit_quality(docs: DataFrame, labels: DataFrame, learn, label_col: str = "quality",
                max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model as a small dict: weights of ``2**HASH_BITS`` features and the curve."""
    sample = labelled_sample(docs, labels, label_col, learn, max_labelled, id_col, text_col)
    sample = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label", "draw")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        one = int((pdf["label"] == 1).sum())
        if min(one, len(pdf) - one) < 4:
            share = (one + 1) / (len(pdf) + 2)
            return pd.DataFrame({"w": [b""], "ratio": [b""], "bias": [0.0], "a": [0.0],
                                 "b": [float(np.log(share / (1 - share)))]})
        return _fit(pdf)

    rows = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        fit, "w binary, ratio binary, bias double, a double, b double").collect()
    if not rows:
        return {"w": b"", "ratio": b"", "bias": 0.0, "a": 0.0, "b": 0.0}
    return {k: bytes(v) if k in ("w", "ratio") else v for k, v in rows[0].asDict().items()}


def score_text(text: str | None, w: np.ndarray, ratio: np.ndarray, bias: float, a: float, b: float) -> float:
    margin = _margin(indicators(text or ""), w, ratio, bias) if len(w) else 0.0
    return float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))


def score_quality(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with one further column, the score of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        w, ratio = (np.frombuffer(m[k], np.float32) for k in ("w", "ratio"))
        for texts in parts:
            yield pd.Series([score_text(t, w, ratio, m["bias"], m["a"], m["b"]) for t in texts], dtype="float64")

    udf = F.pandas_udf(scored, "double")
    return docs.withColumn(out, udf(text_or_empty(F.col(text_col))))
