"""Operator 4: toxicity by Levenshtein automata over a lexicon trie, with context windows.

Learning, from a bounded sample of labelled rows (``max_labelled``, half of either
class at most, seeded draw; ids, source and lang are not read):

* the lexicon: words far commoner in toxic than in clean texts. A word's support is
  the number of different neighbourhoods (word before, word after) it has there, so
  a toxic text and its copies do not turn their ordinary words into terms;
  A term weighs the logarithm of its ratio, 1 at most;
* the surface forms near a term that clean texts use, which are never misspellings;
* a logistic model of the hit counts, with a prior that ranks exact terms over
  misspelt ones over quoted ones where the sample says nothing.

Matching: the lexicon is a trie; a Levenshtein automaton runs over it in one pass of
the word, its states being sets of (trie node, edits spent). States are determinised
on demand and kept, so a word costs one table look-up a letter. A term of under 4
letters allows no edit, of 4 to 7 one, longer ones two. Letters are lower-cased,
look-alike digits and signs count as the letters they stand for, signs inside or
around a word are dropped and letters held three times or more count twice.

Context: in a window of ``WINDOW`` words, a hit between quotation marks or beside a
word of reporting is quotation; a second-person word beside it is abuse again. A hit
counts (1 - quotation) as abuse and the rest as quotation.

Scoring streams over whole texts without a shuffle. Defined results: a null text
counts as empty and scores the model's floor; contradicting or null labels are not
learned from; a sample without toxic rows gives an empty lexicon and one low score;
repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty
from .quality import labelled_sample

MAX_LABELLED = 8000
MIN_SUPPORT = 5
MIN_RATIO = 25.0
SURE_RATIO = 200.0
WINDOW = 6
MEMO = 200_000

# Signs and digits read as the letters they imitate.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
                            "@": "a", "$": "s", "!": "i", "|": "l"})
REPORTING = frozenset("said says say saying called calls wrote writes quoted quote quotes quoting word words "
                      "term terms insult insults slur slurs shouted yelled dit dijo sagte rief palabra mot wort".split())
SECOND_PERSON = frozenset("you your youre you're u ur yourself tu te toi vous du dich dir ihr usted vos eres".split())
OPEN_QUOTES = "\"'“„«‹‘"
CLOSE_QUOTES = "\"'”“»›’"

# exact, one edit, two edits, quoted exact, quoted misspelt
PRIOR = np.array([4.0, 2.5, 0.8, 0.6, 0.2])


def plain(token: str) -> str:
    """The letters a token stands for."""
    t = token.lower().strip("*%&#.,;:!?()[]{}<>\"'“”„«»‹›‘’|=+~^_/\\-–—")
    if not t.isalpha():
        t = t.translate(LOOK_ALIKE)
        t = "".join(c for c in t if c.isalpha())
    return re.sub(r"(.)\1{2,}", r"\1\1", t) if len(t) > 2 else t


def edits_allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 8 else 2


class LexiconAutomaton:
    """The lexicon's trie and the on-demand determinised Levenshtein automaton over it."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            at = 0
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                at = self.children[at][c]
            self.term[at] = t
        self.letters = {c for kids in self.children for c in kids}
        self.most = [0] * len(self.children)  # edits allowed by any term below
        for node in range(len(self.children) - 1, -1, -1):
            own = edits_allowed(len(self.term[node])) if self.term[node] else 0
            self.most[node] = max([own, *(self.most[k] for k in self.children[node].values())])
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        todo = list(spent)
        while todo:  # skipping a letter of the term
            node = todo.pop()
            e = spent[node] + 1
            for kid in self.children[node].values():
                if e <= self.most[kid] and e < spent.get(kid, 99):
                    spent[kid] = e
                    todo.append(kid)
        key = tuple(sorted(spent.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        spent: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.most[node] and e + 1 < spent.get(node, 99):
                spent[node] = e + 1
            for letter, kid in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[kid] and cost < spent.get(kid, 99):
                    spent[kid] = cost
        return self._state(spent)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and the edits; smaller term on ties."""
        if len(self.moves) > MEMO:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.letters else ""
            nxt = self.moves.get((state, c))
            if nxt is None:
                nxt = self.moves[(state, c)] = self._move(state, c)
            if not nxt:
                return None
            state = nxt
        found = [(e, self.term[n]) for n, e in self.states[state]
                 if self.term[n] and e <= edits_allowed(len(self.term[n]))]
        return (min(found)[1], min(found)[0]) if found else None


def quotation(tokens: list[str], i: int) -> float:
    """0 (used) to 1 (quoted): what the window around token i says."""
    lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
    opened = any(t[:1] in OPEN_QUOTES and t for t in tokens[lo:i + 1])
    closed = any(t.rstrip(".,;:!?*%&#$")[-1:] in CLOSE_QUOTES and t.rstrip(".,;:!?*%&#$") for t in tokens[i:hi])
    near = {plain(t) for t in tokens[lo:hi]}
    q = 0.6 * (opened and closed) + 0.4 * bool(near & REPORTING)
    return max(0.0, q - 0.5 * bool(near & SECOND_PERSON))


class Scorer:
    """Hits and features of texts; remembers what each surface form matched (bounded)."""

    def __init__(self, terms: dict[str, float], clean_forms: frozenset[str] = frozenset()):
        self.terms = terms
        self.automaton = LexiconAutomaton(list(terms))
        self.clean_forms = clean_forms
        self.memo: dict[str, tuple[str, int] | None] = {}

    def hit(self, token: str) -> tuple[str, int] | None:
        if token in self.memo:
            return self.memo[token]
        if len(self.memo) > MEMO:
            self.memo.clear()
        word = plain(token)
        found = self.automaton.match(word) if len(word) > 2 else None
        if found and found[1] and word in self.clean_forms:
            found = None
        self.memo[token] = found
        return found

    def hits(self, text: str) -> list[tuple[int, str, int, float]]:
        """``(token number, term, edits, quotation)`` of every hit of a whole text."""
        tokens = text.split()
        toxic = {t for t in set(tokens) if self.hit(t)}
        if not toxic:
            return []
        return [(i, *self.hit(t), quotation(tokens, i)) for i, t in enumerate(tokens) if t in toxic]

    def features(self, text: str) -> np.ndarray:
        f = np.zeros(5)
        for _, term, edits, q in self.hits(text):
            weight = self.terms[term]
            f[min(edits, 2)] += (1 - q) * weight
            f[3 if edits == 0 else 4] += q * weight
        return np.log1p(f)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        word, context, label = [], [], []
        for text, y in zip(pdf["text"], pdf["label"]):
            tokens = [plain(t) for t in text.split()]
            seen = set()
            for before, w, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
                if 2 < len(w) < 30 and w not in seen:
                    seen.add(w)
                    word.append(w)
                    context.append(f"{before} {after}")
                    label.append(y)
        yield pd.DataFrame({"word": pd.Series(word, dtype=object), "context": pd.Series(context, dtype=object),
                            "label": pd.Series(label, dtype="int32")})


def learn_lexicon(sample: DataFrame) -> DataFrame:
    """``(word, support, ratio)``: all terms of the sample, which bounds them."""
    seen = sample.mapInPandas(_contexts, "word string, context string, label int")
    per = seen.groupBy("word", "context").agg(F.max("label").alias("toxic"), F.min("label").alias("lo"))
    per = per.groupBy("word").agg(F.sum("toxic").alias("support"), F.sum(1 - F.col("lo")).alias("clean"))
    total = sample.agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0")).first()
    share = ((total["n0"] or 0) + 1) / ((total["n1"] or 0) + 1)
    ratio = (F.col("support") + 0.5) / (F.col("clean") + 0.5) * F.lit(float(share))
    return per.select("word", "support", ratio.alias("ratio")).where(
        (F.col("support") >= MIN_SUPPORT) & (F.col("ratio") >= MIN_RATIO))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """MAP weights with means ``PRIOR``; classes weigh alike in the bias' start only."""
    w, b = PRIOR.copy(), -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (p - y) + 0.5 * (w - PRIOR), (p - y).sum() + 0.05 * (b + 2))
        q = p * (1 - p) + 1e-9
        xx = np.hstack([x, np.ones((len(x), 1))])
        h = (xx * q[:, None]).T @ xx + np.diag([0.5] * len(w) + [0.05])
        step = np.linalg.solve(h, g)
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-9:
            break
    return np.maximum(w, 0.0), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, label_col: str = "toxic",
                 max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: terms, clean surface forms, weights and bias (all bounded by the sample)."""
    sample = labelled_sample(docs, labels, label_col, learn, max_labelled, id_col, text_col)
    sample = sample.select("text", "label")
    terms = {r["word"]: min(1.0, math.log(r["ratio"]) / math.log(SURE_RATIO))
             for r in learn_lexicon(sample).collect()}

    def near_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(terms)
        for pdf in batches:
            forms: Counter[str] = Counter()
            for text, y in zip(pdf["text"], pdf["label"]):
                if y == 0:
                    forms.update({plain(t) for t in set(text.split()) if (h := scorer.hit(t)) and h[1]})
            yield pd.DataFrame({"form": pd.Series(list(forms), dtype=object)})

    forms = sample.mapInPandas(near_terms, "form string").distinct()
    clean = frozenset(r["form"] for r in forms.collect())

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(terms, clean)
        for pdf in batches:
            yield pd.DataFrame({"f": [scorer.features(t).tolist() for t in pdf["text"]], "label": pdf["label"]})

    rows = sample.mapInPandas(described, "f array<double>, label int").collect()
    x = np.array([r["f"] for r in rows]).reshape(-1, 5)
    w, b = fit_logistic(x, np.array([r["label"] for r in rows], dtype=float))
    return {"terms": terms, "clean": clean, "w": w.tolist(), "b": b}


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with one further column, the score of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        scorer, w = Scorer(m["terms"], m["clean"]), np.array(m["w"])
        for texts in parts:
            yield pd.Series([1 / (1 + math.exp(-min(30.0, max(-30.0, float(scorer.features(t) @ w) + m["b"]))))
                             for t in texts], dtype="float64")

    return docs.withColumn(out, F.pandas_udf(scored, "double")(text_or_empty(F.col(text_col))))
