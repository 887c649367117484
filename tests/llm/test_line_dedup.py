import random

from hypothesis import given, settings, strategies as st
from marketlake.llm import line_dedup as L
from pyspark.sql import functions as F

from .texts import sentence


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


@given(st.text("ab", max_size=9), st.text("abc", max_size=9), st.integers(1, 3))
@settings(max_examples=400, deadline=None)
def test_banded_distance_and_bounds(a, b, t):
    d = distance(a, b)
    assert L.within(a, b, t) == (d <= t)
    assert bin((L.parity(a) ^ L.parity(b)) & (1 << 64) - 1).count("1") <= 2 * d
    x, y = (a, b) if len(a) >= len(b) else (b, a)
    if d <= t and len(y) > t:
        own = {(len(y), i, y[p:p + s]) for i, (p, s) in enumerate(L.segments(len(y), t), 1)}
        assert own & {(n, i, x[p:p + s]) for n, i, p, s, _ in L.probes(len(x), t)}


def corpus():
    rng = random.Random(4)
    base = [sentence(rng, 8, 10**5) for _ in range(30)]

    def typo(s):
        k = rng.randrange(len(s))
        return s[:k] + rng.choice(["", "z", s[k] + "q"]) + s[k + 1:]
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "short\nshort\nshort"), (5, "short "), (6, "shart")]
    for i in range(80):
        lines = [rng.choice(base) for _ in range(3)]
        lines[0] = typo(lines[0]) if i % 2 else typo(typo(typo(lines[0])))
        rows.append((10 + i, "\n".join([*lines, "", f"own line number {i * 7919} of this document"])))
    rows += [(None, base[0]), (200, base[0]), (200, base[0]), (201, "y" * 60_000), (202, "y" * 59_999 + "z"),
             (203, "é\U0001F600" * 40), (204, "é\U0001F600" * 39 + "é")]
    return rows


def expected(rows):
    lines = sorted({l for _, t, *_ in rows for _, l in L.lines_of(t or "")})
    parent = {l: l for l in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    long = [l for l in lines if len(l) >= L.MIN_LENGTH]
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= 2 and (len(a) > 10_000 and L.within(a, b, 2) or len(a) <= 10_000 and distance(a, b) <= 2):
                parent[find(a)] = find(b)
    seen, out = set(), []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        found = list(L.lines_of(text or ""))
        dropped = []
        for at, line in found:
            if find(line) in seen:
                dropped.append(at)
            seen.add(find(line))
        out.append((doc, len(found), len(dropped), dropped))
    return sorted(out, key=str)


def test_dropped_lines_equal_brute_force(docs):
    rows = corpus()
    got = L.dropped_lines(docs(rows)).select("doc_id", "n_lines", "n_dropped", "dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert L.dropped_lines(docs([])).count() == 0


def test_texts_without_the_lines(docs):
    rows = [(1, "a\n\nb\na"), (2, "b\nc"), (3, None)]
    frame = docs(rows).select("doc_id", "text")
    out = frame.join(L.dropped_lines(frame), "doc_id").select("doc_id", L.without_lines(F.col("text"), F.col("dropped")).alias("t"))
    assert {r["doc_id"]: r["t"] for r in out.collect()} == {1: "a\n\nb", 2: "c", 3: ""}


@given(st.text("ab ", min_size=1, max_size=60), st.integers(0, 9), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_far_distance(a, edits, rng):
    b = a
    for _ in range(edits):
        k = rng.randrange(len(b) + 1)
        b = b[:k] + rng.choice(["", "a", "c", b[k:k + 1] + "b"]) + b[k + 1:]
    for t in (1, 3, 6, 9):
        assert L.within_far(a, b, t) == (distance(a, b) <= t)


def graded_rows():
    rng = random.Random(6)
    allowed = L.Allowance(L.MAX_EDITS, L.MIN_LENGTH, L.SHARE)

    def changed(s, n):
        for _ in range(n):
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice(["", "z", s[k] + "q"]) + s[k + 1:]
        return s
    lines = ["a", "b", "ab", "ac", "abc", "abd", "all rights reserved", "all rights reservd", "All Rights Reserved",
             "y" * 400, "y" * 388, "y" * 370]
    for words in (3, 5, 16, 17, 18, 19, 35):
        for _ in range(2):
            base = sentence(rng, words, 10**6)
            n = allowed.edits(len(base))
            lines += [base, changed(base, n), changed(base, max(1, n - 1)), changed(base, n + 3)]
            at = len(base) // 2
            lines += [base[:at] + "x" * n + base[at + n:], "t" * n + base]
    long = sentence(rng, 43, 10**6)
    lines += [long, long.replace(long.split()[20], "other77")]
    keys = L._gram_keys([(1, long), (2, long[1:])], allowed)
    assert set(keys["sketch"]) == {L.parity(long), L.parity(long[1:])}
    # the same long passage in many lines that are not near otherwise
    passage = sentence(rng, 20, 10**6)
    lines += [f"{sentence(rng, 30, 10**6)} {passage} {sentence(rng, 30, 10**6)}" for _ in range(20)]
    rng.shuffle(lines)
    return [(i, l) for i, l in enumerate(lines)]


def test_allowance_grows_with_the_line(docs):
    rows = graded_rows()
    allowed = L.Allowance(L.MAX_EDITS, L.MIN_LENGTH, L.SHARE)
    label = {l: l for _, l in rows}
    texts = sorted(label)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            t = allowed.edits(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= t and label[a] != label[b] and distance(a, b) <= t:
                old, new = label[a], label[b]
                label = {l: new if c == old else c for l, c in label.items()}
    seen, expect = set(), {}
    for i, l in rows:
        expect[i] = [0] if label[l] in seen else []
        seen.add(label[l])
    got = L.dropped_lines(docs(rows), share=L.SHARE).select("doc_id", "dropped").collect()
    assert {r["doc_id"]: r["dropped"] for r in got} == expect
    assert len(seen) < len(texts)


def test_query_links_short_lines_and_swapped_words(spark, tmp_path):
    from marketlake.llm.queries import op5_line_dedup
    rng = random.Random(7)
    long = sentence(rng, 50, 10**5)
    swapped = long.replace(long.split()[25], "another")
    rows = [(1, long), (2, swapped), (3, "all rights reserved"), (4, "all rights reservd")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_line_dedup(spark, str(tmp_path)).select("doc_id", "n_near").collect()
    assert dict(map(tuple, got)) == {1: 0, 2: 1, 3: 0, 4: 1}


def test_fewer_keys_a_letter():
    rng = random.Random(8)
    allowed = L.Allowance(L.MAX_EDITS, L.MIN_LENGTH, L.SHARE)
    lines = [(i, sentence(rng, rng.randrange(20, 200), 10**6)) for i in range(300)]
    keys = L._gram_keys(lines, allowed)
    assert set(keys["line"]) == {i for i, _ in lines}
    assert 14 * len(keys) < sum(len(l) for _, l in lines)


def test_packed_keys_keep_near_lines_and_hot_keys(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(L, "HOT_ROWS", 5)
    rng = random.Random(9)
    allowed = L.Allowance(L.MAX_EDITS, L.MIN_LENGTH, L.SHARE)
    base = [sentence(rng, w, 10**6) for w in (2, 6, 12, 30, 60, 400)]
    lines = [*base]
    for b in base:
        for _ in range(12):
            n, s = rng.randint(1, max(1, allowed.edits(len(b)) // 2)), b
            for _ in range(n):
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice(["", "z", s[k] + "q"]) + s[k + 1:]
            lines.append(s)
    lines = sorted({l for l in lines})
    rng.shuffle(lines)
    # three tasks; hot keys in some of them only
    parts = [lines[:50], lines[50:52], lines[52:]]
    packed = pd.concat([f for p in parts for f in L._keyed(allowed, 3)(iter([pd.DataFrame({"text": ["\n".join(p)]})]))])
    assert packed["hot"].any() and not packed["hot"].all()
    rows = pd.concat([L._shared(allowed, g, f) for g, f in packed.groupby(["bucket", "hot"])])
    keys = {h: set() for h in (L.line_hash(l)[0] for l in lines)}
    for key, line in zip(rows["key"], rows["line"]):
        keys[line].add(key)
    own = set(rows["key"][rows["own"]])
    near = 0
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if min(len(a), len(b)) >= allowed.shortest and L.linked(a, b, allowed):
                near += 1
                assert keys[L.line_hash(a)[0]] & keys[L.line_hash(b)[0]] & own
                t = allowed.edits(min(len(a), len(b)))
                x, y = L.letter_counts([a, b])
                assert sum(int(v).bit_count() for v in (x ^ y).view("u8")) <= 2 * t
    assert near > 100


def test_one_key_of_a_shared_passage_stays(spark):
    rows = [(k, line, at + 20 * k + (line == 9 and k > 5) * 3, True) for k in range(10) for line, at in ((7, 0), (8, 40), (9, 2))]
    rows += [(77, 7, 0, True), (77, 8, 40, False), (78, 7, 0, True), (78, 8, 40, True)]
    frame = spark.createDataFrame([(k, l, a, a, o) for k, l, a, o in rows + rows[:1]], L.KEY_ROWS)
    got = {(r["key"], r["line"]) for r in L.without_repeated_groups(frame).collect()}
    assert got == {(k, line) for k in (0, 6) for line in (7, 8, 9)} | {(k, line) for k in (77, 78) for line in (7, 8)}


def test_many_distances_at_once():
    import numpy as np
    rng = random.Random(10)
    for alphabet in ("ab ", "abcdé\U0001F600 ", [chr(0x4E00 + i) for i in range(600)]):
        lines = ["x", "y" * 300, "y" * 290 + "z"]
        for _ in range(30):
            base = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90)))
            for _ in range(4):
                s = base
                for _ in range(rng.randint(0, 9)):
                    k = rng.randrange(len(s) + 1)
                    s = s[:k] + rng.choice(["", "z", "ab"]) + s[k + rng.randint(0, 1):]
                lines.append(s or "x")
        size = np.array([len(l) for l in lines])
        start = np.cumsum(size) - size
        codes, exact = L.coded(lines)
        assert exact == (len(alphabet) < 256)
        i = np.array([rng.randrange(len(lines)) for _ in range(1500)])
        j = np.clip(i + np.array([rng.randint(-3, 3) for _ in i]), 0, len(lines) - 1)
        t = np.array([rng.randint(0, 14) for _ in i])
        d = np.array([distance(lines[x], lines[y]) for x, y in zip(i, j)])
        got = L.within_each(codes, start, size, i, j, t)
        assert (got == (d <= t)).all() if exact else got[d <= t].all()
        counts = L.bigram_counts(codes, start, size).astype(int)
        assert (np.abs(counts[i] - counts[j]).sum(axis=1) <= 4 * d).all()


def numbered(most=400):
    """Lines that differ in up to four digits: most are no more than two edits from some others."""
    rng = random.Random(11)
    base = sentence(rng, 8, 10**5)[:60].strip()
    return [(i, f"{base} {n:04d}") for i, n in enumerate(rng.sample(range(10_000), most))]


def test_links_of_a_family_do_not_grow_with_its_square(docs):
    rows = numbered()
    found = docs(rows).select("doc_id", "text")
    links = L.line_links(found, sum(len(l) for _, l in rows), share=L.SHARE).collect()
    assert len(links) < 3 * len(rows)  # 4,412 when each pair across components was listed
    rows = numbered(100)
    found = docs(rows).select("doc_id", "text")
    got = L.dropped_lines(found, share=L.SHARE).select("doc_id", "n_lines", "n_dropped", "dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_large_groups_are_split(docs, monkeypatch):
    monkeypatch.setattr(L, "SPLIT_ROWS", 7)
    rows = graded_rows() + [(1000 + i, l) for i, l in numbered(90)]
    whole = docs(rows).select("doc_id", "text")
    got = {tuple(r) for r in L.dropped_lines(whole, share=L.SHARE).select("doc_id", "n_dropped", "n_near").collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in L.dropped_lines(whole, share=L.SHARE).select("doc_id", "n_dropped", "n_near").collect()}


def test_frames_end_where_groups_end(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(L, "TOGETHER_ROWS", 10)
    rows = pd.DataFrame([(lead, part, 1, 9) for lead, part, n in ((1, 0, 3), (2, 0, 25), (2, 1, 4), (3, 0, 1), (5, 0, 12)) for _ in range(n)],
                        columns=["lead", "part", "line", "n"])
    frames = list(L.whole_groups(rows[i:i + 6] for i in range(0, len(rows), 6)))
    assert len(frames) > 2 and pd.concat(frames, ignore_index=True).equals(rows)
    ends = [tuple(f[["lead", "part"]].iloc[-1]) for f in frames]
    assert all(tuple(f[["lead", "part"]].iloc[0]) != end for f, end in zip(frames[1:], ends))
