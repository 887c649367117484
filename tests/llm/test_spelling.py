import random
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st
from marketlake.llm import spelling as S
from marketlake.llm.queries import op13_spelling_variants

from .test_line_dedup import distance

LETTERS = "abcdeéÿ×ñ"


@given(st.lists(st.text("abcéÿ", min_size=1, max_size=6), min_size=2, max_size=6, unique=True), st.sampled_from([1, 2, 8]))
@settings(max_examples=300, deadline=None)
def test_neighbourhoods_meet_each_near_pair_once(words, symbols):
    of, key, same = S.reduced_keys(words, symbols)
    own = {w: key[(of == i) & same][0] for i, w in enumerate(words)}
    for i, a in enumerate(words):
        for b in words:
            if a < b and distance(a, b) == 1:
                hits = sum(int(k == own[y]) for x, y in ((a, b), (b, a))
                           for k, s in zip(key[of == words.index(x)], same[of == words.index(x)]) if not s or x < y)
                assert hits == 1, (a, b)


def brute(rows, every):
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
                run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if distance(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus():
    rng = random.Random(13)
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([4, 5, 6, 9]))) for _ in range(60)]
    words = []
    for w in base:
        for _ in range(rng.choice([1, 5, 20, 60])):
            k = rng.randrange(len(w))
            words += [w, w.upper() if rng.random() < .2 else w, w[:k] + rng.choice([w[k + 1:], rng.choice(LETTERS) + w[k:]])]
    for k, n in enumerate([99, 48, 23, 11, 5]):  # a chain of forms
        words += ["b" * (8 - k) + "c" * k] * n
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 9:i * 9 + 9])) for i in range(len(words) // 9)]
    rows += [(None, "null_id null_id null-id!"), (1, None), (2, ""), (2, "2same 3same; same" * 3), (2, "2same 3same; same" * 3),
             (3, "y" * 20_000), (4, "y" * 20_000 + " " + "y" * 19_999), (5, "y" * 20_000), (6, "y" * 19_999), (7, "y" * 19_999)]
    return rows


def test_against_brute_force(spark):
    rows = [r for r in corpus() if not r[1] or len(r[1]) < 1000]
    df = spark.createDataFrame([(t, "x", d) for d, t in rows], "text string, word string, doc_id long")
    got = S.spelling_variants(S.word_counts(df, typo_every=7)).collect()
    assert len(got) > 60 and any(r.root != r.form for r in got if r.form)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(rows, 7)


def test_long_runs_and_no_rows(spark):
    rows = [r for r in corpus() if r[1] and len(r[1]) > 1000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {len(r.word): r.n_near for r in S.spelling_variants(S.word_counts(df)).collect()}
    assert got == {20_000: 1, 19_999: 1}
    none = S.spelling_variants(S.word_counts(df.limit(0)))
    assert none.columns == ["word", "form", "root", "n", "n_near", "form_n"] and none.collect() == []


def test_query_reads_whole_texts(spark, tmp_path):
    rows = [(i, f"{'word ' * 3000} lastword") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word: r.n for r in op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got["lastword"] >= 3
