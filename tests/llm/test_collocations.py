import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from marketlake.llm import collocations as C, quotient_filter as Q

KEYS = st.lists(st.tuples(st.integers(0, 2**64 - 1) | st.integers(0, 3), st.integers(0, 5), st.integers(1, 400)), max_size=60)


def as_counts(keys):
    x, y, n = (np.array(c, dtype=t) for c, t in zip(zip(*keys), (np.uint64, np.uint64, np.int64))) if keys else (
        np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Q.collapse(*Q.permute(x, y), n)


@given(KEYS, KEYS, st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_filters_keep_every_key_and_count(a, b, bits):
    parts = {}
    for keys in (a, b):
        for shard, data in Q.by_shard(as_counts(keys), bits):
            parts.setdefault(shard, []).append(Q.unpack(data, shard))
    got = Counter()
    for filters in parts.values():
        hi, lo, n = Q.merge(filters)
        assert (hi[1:] >= hi[:-1]).all()
        x, y = Q.restore(hi, lo)
        for key, c in zip(zip(x.tolist(), y.tolist()), n.tolist()):
            assert key not in got
            got[key] = c
    want = Counter()
    for x, y, n in a + b:
        want[x, y] += n
    assert got == want


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    n = 100_000
    counts = Q.collapse(*Q.permute(np.arange(n, dtype=np.uint64), rng.integers(0, 9, n).astype(np.uint64)),
                        rng.integers(1, 40, n))
    assert len(Q.pack(counts, 0, 0)) < 15.5 * n


def brute(rows, least, longest, top, share):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in cand.items()):
            continue
        s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out.sort()
    rank, rows = Counter(), []
    for lang, s, a, p, l, r in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -s))
    return rows


def corpus():
    rng = random.Random(11)
    words = ["a", "B", "new", "New", "york", "city", "é", "É", "ß x", "\U0001F600", "\u0085", "x\x00", "'q'"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" "] * 8 + ["\t", "  ", ". ", ", ", "\n", "\x0b", "!?"]) for _ in range(40))
        rows.append((rng.choice(["en", "en", "de", "und", None]), text + (" the new york stock exchange" if i % 3 == 0 else "")))
    return rows + [("en", None), ("fr", ""), ("en", "..."), ("en", "one two " * 5000), rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "p", 1, None) for lang, text in rows],
                                 "lang string, text string, phrase string, n int, doc_id long")


def collected(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_against_brute_force(spark):
    rows = corpus()
    for least, longest, top, share in ((5, 4, 40, 80), (30, 4, 2000, 80), (2, 3, 2000, 50)):
        want = brute(rows, least, longest, top, share)
        assert want and collected(C.collocations(frame(spark, rows), least, longest, top, share)) == want


def test_small_chunks_shards_and_flushes(spark, monkeypatch):
    rows = corpus()
    for name, value in (("CHUNK_BYTES", 500), ("HELD_WORDS", 5), ("HELD_KEYS", 20), ("SHARD_WORDS", 1000), ("BITMAP_BITS", 6)):
        monkeypatch.setattr(C, name, value)
    assert collected(C.collocations(frame(spark, rows).repartition(3), 5)) == brute(rows, 5, 4, 2000, 80)


def test_colliding_word_ids_take_the_next_seed(spark, monkeypatch):
    rows, hashes = corpus(), C.run_hashes

    def poor(b, starts, ends, seed):
        h = hashes(b, starts, ends, seed)
        return h & np.uint64(1) if seed == 1 else h
    monkeypatch.setattr(C, "run_hashes", poor)
    assert collected(C.collocations(frame(spark, rows), 5)) == brute(rows, 5, 4, 2000, 80)


def test_no_rows(spark):
    none = C.collocations(frame(spark, corpus()).limit(0))
    assert none.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and none.collect() == []


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    row = spark.range(1).select(C.score(*(C.F.lit(x) for x in (big, big, big + 7))).alias("s")).first()
    assert row.s == 2_000_000 * big // (2 * big + 7)
