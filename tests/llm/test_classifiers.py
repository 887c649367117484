import random

import numpy as np
import pytest
from conftest import SF01
from marketlake.llm import quality as Q, toxicity as T
from marketlake.llm.common import fold, table
from pyspark.sql import functions as F

from .texts import sentence

LABELS = "doc_id long, quality int, toxic int, text string"


def held_out(spark, fit, score, fold_of, label):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    n, k = fold_of
    model = fit(docs, labels, fold(F.col("doc_id"), n) != k)
    rows = score(docs.where(fold(F.col("doc_id"), n) == k), model).join(labels, "doc_id").select("score", label).collect()
    return np.mean([(r["score"] >= 0.5) == (r[label] == 1) for r in rows]), len(rows)


def test_quality_held_out_accuracy(spark):
    accuracy, n = held_out(spark, Q.fit_quality, Q.score_quality, (3, 1), "quality")
    assert n > 80 and accuracy >= 0.95


def test_toxicity_held_out_accuracy(spark):
    accuracy, n = held_out(spark, T.fit_toxicity, T.score_toxicity, (5, 0), "toxic")
    assert n > 50 and accuracy >= 0.93


def odd_rows():
    return [(1, None), (2, ""), (3, " \n"), (None, "x"), (4, "rep"), (4, "rep"), (5, "word " * 60_000), (6, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]


@pytest.mark.parametrize("fit,score", [(Q.fit_quality, Q.score_quality), (T.fit_toxicity, T.score_toxicity)])
def test_odd_rows_and_labels(spark, docs, fit, score):
    rng = random.Random(1)
    good = [(100 + i, sentence(rng, 60) + " fine") for i in range(30)]
    bad = [(200 + i, " ".join(w + "###" for w in sentence(rng, 60).split()) + " vilestword here") for i in range(30)]
    labels = [(i, 1, 0, None) for i, _ in good] + [(i, 0, 1, None) for i, _ in bad]
    labels += [(1, None, None, None), (2, 0, 0, None), (2, 1, 1, None), (None, 1, 1, None), (999, 1, 1, None)]
    frame = docs(good + bad + odd_rows())
    known = spark.createDataFrame(labels, LABELS)
    model = fit(frame, known, F.lit(True))
    out = score(frame, model, out="p").select("doc_id", "p").collect()
    assert len(out) == 68 and all(0.0 <= r["p"] <= 1.0 for r in out)
    empty = {r["p"] for r in out if r["doc_id"] in (1, 2)}
    assert len(empty) == 1 and len({r["p"] for r in out if r["doc_id"] == 4}) == 1
    assert score(docs([]), model, out="p").count() == 0
    # no labels at all: a defined, equal score for every text
    blank = fit(frame, known.where("false"), F.lit(True))
    assert len({round(r["p"], 9) for r in score(frame.where("doc_id < 100"), blank, out="p").collect()}) == 1


def test_dual_coordinate_descent_separates():
    rng = np.random.RandomState(0)
    rows = [np.unique(np.append(rng.randint(100, 4000, 40), 5 if i % 2 else 6)) for i in range(200)]
    y = np.array([1 if i % 2 else -1 for i in range(200)])
    w, bias, ratio = Q.fit_nbsvm(rows[:150], y[:150])
    assert ratio[5] > 0 > ratio[6]
    assert np.mean([np.sign(Q._margin(r, w, ratio, bias)) == t for r, t in zip(rows[150:], y[150:])]) >= 0.95


def test_dual_coordinate_descent_on_dense_rows():
    """The same steps on dense rows in plain Python; with many rounds the duality gap closes."""
    rng = np.random.RandomState(3)
    rows = [np.unique(rng.randint(0, 25, 6)) for _ in range(40)]
    y = np.array([1 if (4 in r) != (rng.rand() < .15) else -1 for r in rows])
    for epochs in (1, 5, 400):
        w, bias, ratio = Q.fit_nbsvm(rows, y, epochs=epochs)
        n = {t: [1 + sum(int(j in r) for r, c in zip(rows, y) if c == t) for j in range(25)] for t in (1, -1)}
        rest = (1 << Q.HASH_BITS) - 25  # features nobody has are smoothed too
        log = {t: [np.log(k / (sum(n[t]) + rest)) for k in n[t]] for t in (1, -1)}
        r_of = [a - b if n[1][j] + n[-1][j] > 2 else 0.0 for j, (a, b) in enumerate(zip(log[1], log[-1]))]
        x = []
        for r in rows:
            length = sum(r_of[j] ** 2 for j in r) ** 0.5
            x.append([r_of[j] / length if j in r else 0.0 for j in range(25)] + [1.0])
        most = {t: len(y) / (2 * int((y == t).sum())) for t in (1, -1)}
        v, dual, order = [0.0] * 26, [0.0] * len(rows), np.random.RandomState(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                t = int(y[i])
                slope = t * sum(a * b for a, b in zip(v, x[i])) - 1
                new = min(max(dual[i] - slope / 2, 0.0), most[t])
                v = [a + (new - dual[i]) * t * b for a, b in zip(v, x[i])]
                dual[i] = new
        assert np.allclose(w[:25], [a * b for a, b in zip(v, r_of)], atol=1e-5) and abs(bias - v[25]) < 1e-9
        assert np.allclose(ratio[:25], r_of, atol=1e-5) and not w[25:].any()
    loss = sum(most[int(t)] * max(0.0, 1 - t * sum(a * b for a, b in zip(v, row))) for t, row in zip(y, x))
    square = sum(a * a for a in v) / 2
    assert square + loss - (sum(dual) - square) < 1e-3


def test_slices_see_what_the_whole_text_has(monkeypatch):
    text = sentence(random.Random(2), 500) + " É %% 12"
    whole = Q.indicators(text)
    monkeypatch.setattr(Q, "SLICE", 128)
    assert set(whole) <= set(Q.indicators(text))


def brute(term, word):
    p = list(range(len(word) + 1))
    for i, c in enumerate(term, 1):
        q = [i]
        for j, d in enumerate(word, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def test_automaton_equals_edit_distance():
    terms = ["abc", "abcd", "bcda", "abcdabcd", "ddddaaaa", "cab"]
    automaton = T.LexiconAutomaton(terms)
    rng = random.Random(3)
    for _ in range(4000):
        word = "".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 10)))
        best = min(((brute(t, word), t) for t in terms if brute(t, word) <= T.edits_allowed(len(t))), default=None)
        assert automaton.match(word) == (best and (best[1], best[0]))


def test_misspelling_and_quotation():
    scorer = T.Scorer({"idiot": 1.0, "worthless": 1.0})
    for text in ("You ID10T!", "what an i-d-i-o-t", "iddiot***", "w0rthles"):
        assert scorer.hits(text), text
    assert not scorer.hits("an idea with worth")
    used = scorer.features("you are an idiot and that is all there is to say about it today")
    told = scorer.features('the report quoted him as saying "idiot" in the second hearing of the case')
    assert used[0] > told[0] and told[3] > used[3]
    w = np.array([4.0, 2.5, 0.8, 0.6, 0.2])
    assert used @ w > told @ w


def test_copies_do_not_make_terms(spark):
    copies = [("rareone raretwo rarethree common here", 1)] * 40 + [("ordinary text " * 3, 0)] * 40
    varied = [(f"{c * 3}q vileword {c * 2}z", 1) for c in "abcdefghijklmnoprstuvwxy"]
    sample = spark.createDataFrame(copies + varied, "text string, label int")
    assert [r["word"] for r in T.learn_lexicon(sample).collect()] == ["vileword"]


def test_no_term_or_clean_form_is_left_out(spark):
    parts = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    terms = [a + b + c for a in parts[:14] for b in parts[14:28] for c in parts[28:40]][:2100]
    rows = [(" ".join(f"{t} {'kwzhv'[k % 5]}{'yj'[k // 5]}x" for t in terms), 1) for k in range(6)]
    rows += [("nothing wrong here", 0)] * 20
    found = T.learn_lexicon(spark.createDataFrame(rows, "text string, label int")).collect()
    assert set(terms) <= {r["word"] for r in found}

    label = [(i, text, y) for i, (text, y) in enumerate(
        [(f"you {w} vile{w} hatefulword {w}", 1) for w in terms[:6]]
        + [("hatefulwora fine", 0), ("hatefulworb fine", 0), ("hatefulworc fine", 0), ("hatefulwore fine", 0)]
        + [(f"all is well {w}", 0) for w in terms[100:116]])]
    docs = spark.createDataFrame(label, "doc_id long, text string, toxic int")
    model = T.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), docs["doc_id"] >= 0)
    assert {"hatefulwora", "hatefulworb", "hatefulworc", "hatefulwore"} <= model["clean"]
