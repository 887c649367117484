import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from marketlake.llm import near_jaccard as J
from marketlake.llm import shingles as S

from .texts import sentence


def word_sets(rows):
    out = []
    for _, text, *_ in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def expected(rows):
    sets, parent = word_sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def corpus():
    rng = random.Random(2)
    passage = sentence(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d e"),
            (8, "a\tb c d\x0be"), (None, "a b c d e"), (9, "Éa éa x y z"), (10, "éa éa x y z")]
    n = 20
    for base in range(30):
        t = sentence(rng, rng.choice([8, 20, 45, 120, 300, 900]), 4000)
        for share in (0.0, 0.0, 0.01, 0.03, 0.05, 0.08):
            rows.append((n := n + 1, edited(rng, t, share)))
    for _ in range(60):  # a common passage in otherwise different texts
        rows.append((n := n + 1, sentence(rng, 40, 5000) + " " + passage))
    base = sentence(rng, 150, 5000)
    rows += [((n := n + 1), edited(rng, base, 0.006 * (k % 6))) for k in range(80)]  # a hot group of near copies
    long = sentence(rng, 20_000, 10**6)
    pair = [sentence(rng, 50, 5000) for _ in range(3)]  # texts that share an id, or have none
    rows += [(9000, pair[0]), (9000, pair[1]), (9001, pair[0] + " x"), (9002, pair[1] + " x"), (None, pair[2]),
             (None, pair[2] + " x"), (None, sentence(rng, 50, 5000))]
    return rows + [(n + 1, long), (n + 2, edited(rng, long, 0.004)), (n + 2, edited(rng, long, 0.001))]


def test_components_equal_brute_force(docs):
    rows = corpus()
    got = sorted((tuple(r) for r in J.jaccard_components(docs(rows)).collect()), key=str)
    assert got == expected(rows)


def test_one_document_of_each_group_stays(docs):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 100]
    frame = docs(rows)
    kept = J.keep_one_per_component(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in expected(rows) if d == c)


def test_shared_and_missing_ids_lose_no_clean_document(docs):
    rng = random.Random(5)
    base, other = sentence(rng, 80, 5000), sentence(rng, 80, 5000)
    lone = [sentence(rng, 30, 5000) for _ in range(40)]
    rows = [(1, base), (2, base + " x"), (2, other), (None, other + " y"), (None, base + " z"), (7, None), (7, " "), (None, "")]
    rows += [(None, t) for t in lone] + [(9, t + " w") for t in [sentence(rng, 30, 5000) for _ in range(40)]]
    rows += [(3, lone[0]), (11, "a b c d e f g"), (11, "a b c d e f g"), (11, "a b c d e f g")]
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one_per_component(docs(rows)).collect()), key=str)
    want = [(1, base), (2, other), (7, None), (7, " "), (None, ""), (3, lone[0]), (11, "a b c d e f g")]
    want += [(None, t) for t in lone[1:]] + [r for r in rows if r[0] == 9]
    assert kept == sorted(want, key=str)


def test_missing_ids_move_each_text_once(spark, docs):
    rng = random.Random(6)
    frame = docs([(None, sentence(rng, 12, 5000)) for _ in range(300)])
    join = J.JaccardJoin(frame)
    assert join.texts_of(join.classes.select("class")).count() == 300


def test_few_members_share_a_key():
    rng = random.Random(7)
    for _ in range(300):  # three of four members in common: one part for all three would hide the link
        b = np.sort(np.array([rng.getrandbits(64) for _ in range(4)], dtype=np.uint64))
        a = b[:3]
        keys = [{(p, int(k)) for p in J.bands(len(s)) for k in S.parity_words(s, p, J.prefix_length(len(s)))} for s in (a, b)]
        assert keys[0] & keys[1]
    for n in range(1, 300):
        assert set(J.bands(n)) >= {J.parts_for(m) for m in range(-(-3 * n // 4), n + 1)}


def test_empty_table(docs):
    assert J.jaccard_components(docs([])).count() == 0


@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(0, 60))
@settings(max_examples=60, deadline=None)
def test_sketches_bound_the_difference(seed, n, changed):
    rng = np.random.RandomState(seed)
    a = np.unique(rng.randint(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[min(changed, len(a)):], rng.randint(0, 2**63, changed, dtype=np.uint64))))
    diff = len(np.setxor1d(a, b))
    p, q = S.parity_sketch(a, 512), S.fold_to(S.parity_sketch(b, 1024), 64)
    assert np.bitwise_count(p ^ q).sum() <= diff
    common = len(np.intersect1d(a, b))
    if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):  # a linked pair shares a key
        shared = set(J.bands(len(a))) & set(J.bands(len(b)))
        keys = [{int(k) for m in J.bands(len(s)) for k in S.parity_words(s, m, J.prefix_length(len(s)))} for s in (a, b)]
        assert shared and keys[0] & keys[1]


@pytest.mark.parametrize("text,words", [("", 0), (" a ", 1), ("A\tb\nc", 3), (" ", 1), ("x" * 70_000, 1)])
def test_word_hashes(text, words):
    assert len(S.word_hashes(text.encode())) == words
    assert (S.word_hashes(text.encode()) == S.word_hashes((" " + text.upper() + "\n").encode())).all()
