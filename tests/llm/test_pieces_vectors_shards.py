import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF01
from marketlake.llm import queries, sharding as S, vector_tree as V, word_pieces as W
from marketlake.llm.common import table
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from .texts import sentence


def reference(begin, go_on):
    vocabulary = {p: i for i, p in enumerate(["[UNK]", *dict.fromkeys(begin), *dict.fromkeys("##" + p for p in go_on)])}
    return Tokenizer(WordPiece(vocabulary, unk_token="[UNK]", continuing_subword_prefix="##", max_input_chars_per_word=10**9))


def test_automaton_counts_what_longest_match_gives():
    rng = random.Random(1)
    for _ in range(60):
        make = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(n)}
        begin, go_on = make(8), make(8)
        automaton, own = W.LongestMatch(sorted(begin), sorted(go_on)), reference(sorted(begin), sorted(go_on))
        for _ in range(100):
            word = "".join(rng.choice("abcd"[:3 + (rng.random() < .1)]) for _ in range(rng.randrange(1, 14)))
            tokens = own.encode(word).tokens
            assert automaton.count(word) == (-1 if tokens == ["[UNK]"] else len(tokens))


def test_whole_texts(spark, docs):
    begin, go_on = W.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    begin = [p for p in begin if p]  # the library's tokenizer knows no bare begin mark
    own = reference(begin, go_on)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "hello  world\x0bagain"), (None, "x"), (5, "rep rep"), (5, "rep rep"),
            (6, "語\U0001F600  wide space"), (7, sentence(random.Random(2), 30_000)), (8, "unbreakable" * 40)]
    got = sorted((tuple(r) for r in W.count_pieces(docs(rows), begin, go_on).collect()), key=str)
    want = []
    for doc, text in rows:
        tokens = [own.encode(w.decode()).tokens for w in (text or "").encode().split()]
        want.append((doc, len(tokens), sum(map(len, tokens)), sum(t == ["[UNK]"] for t in tokens)))
    assert got == sorted(want, key=str)
    assert W.count_pieces(docs([]), begin, go_on).count() == 0


def greedy(word, begin, go_on):
    """Longest match by trying every length; the bare mark only where nothing else begins the word."""
    n, at, pieces = 0, 0, begin
    while at < len(word) or pieces is begin:
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in pieces), 0)
        if not size and not (pieces is begin and "" in begin):
            return -1
        n, at, pieces = n + 1, at + size, go_on
    return n


def test_bare_begin_mark_begins_a_word():
    begin, go_on = map(set, W.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert "" in begin
    automaton = W.LongestMatch(begin, go_on)
    for word in ["ñta", "ç", "ß", "ñandú", "the", "ñ😀", "語", "Éa"]:
        assert automaton.count(word) == greedy(word, begin, go_on), word
    assert automaton.count("ñta") > 1
    rng = random.Random(3)
    for _ in range(60):
        make = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(n)}
        begin, go_on = make(5) | {""}, make(6)
        automaton = W.LongestMatch(begin, go_on)
        for _ in range(100):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
            assert automaton.count(word) == greedy(word, begin, go_on)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_keep_words(size):
    data = b"  one two\nthree " + b"x" * 200 + b" four  "
    parts = list(W.slices(data, size))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, score double, leaf int")


def unit(rng, n, d=16):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def by_query(spark, groups, wanted):
    """Recall of the queries of each group against brute force, in which equally near rows count."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate(groups))]
    at = np.cumsum([0] + [len(g) for g in groups])
    asked = [int(i) for a, b in zip(at, at[1:]) for i in range(a, b, max(1, (b - a) // wanted))]
    found = V.nearest(vectors(spark, rows), lambda i: i.isin(asked), sample_rows=2000)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.score)
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in asked:
        near = np.sort(np.delete(x @ x[q], q))[::-1][:20]
        assert len(got[q]) == 20, q
        group = int(np.searchsorted(at, q, side="right")) - 1
        out.setdefault(group, []).append(sum(s >= near[-1] - 1e-9 for s in got[q]) / 20)
    return {g: float(np.mean(v)) for g, v in out.items()}


def test_copies_do_not_speak_for_small_groups(spark):
    rng = np.random.default_rng(9)
    copies = [np.repeat(unit(rng, 1), 150, axis=0) for _ in range(20)]
    small = []
    for _ in range(12):
        v = unit(rng, 1) + rng.normal(scale=0.02, size=(5, 16))
        small.append(v / np.linalg.norm(v, axis=1, keepdims=True))
    found = by_query(spark, copies + small, 2)
    assert np.mean([found[g] for g in range(20, 32)]) >= 0.9 and np.mean(list(found.values())) >= 0.9


def test_scattered_vectors_of_larger_norm(spark):
    rng = np.random.default_rng(10)
    tight = [unit(rng, 1) + rng.normal(scale=0.01, size=(100, 16)) for _ in range(20)]
    found = by_query(spark, [*tight, 1.5 * unit(rng, 60)], 3)
    assert found[20] >= 0.9 and np.mean(list(found.values())) >= 0.9


def test_neighbours_against_brute_force(spark):
    e = table(spark, SF01, "embeddings")
    found = V.nearest(e, lambda c: c % 20 == 0).cache()
    asked = [r["query_id"] for r in found.select("query_id").distinct().collect()]
    assert len(asked) == 25 and found.count() == 25 * 20
    truth = V.brute_force(e, asked, 20)
    assert V.recall(found, truth) >= 0.9
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in e.collect()}
    by = {}
    for r in found.collect():
        assert abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12 and r["query_id"] != r["vec_id"]
        by.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    for rows in by.values():
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))
        assert sorted(rows) == [(i, *x) for i, x in enumerate(sorted(r[1:] for r in rows), 1)]


def test_vectors_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0]), (None, [1.0, 1.0]), (8, [3.0, 1.0]), (9, [-1.0, 0.0])]
    rows += [(100 + i, [2.0, 0.5]) for i in range(3000)]
    got = V.nearest(vectors(spark, rows), lambda c: c == 0, k=5).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 8, 3.0), (2, 100, 2.0), (3, 101, 2.0), (4, 102, 2.0), (5, 103, 2.0)]
    few = V.nearest(vectors(spark, rows[:10]), lambda c: c == 0, k=5).collect()
    assert [(r["rank"], r["vec_id"]) for r in few] == [(1, 8)]
    assert V.nearest(vectors(spark, []), lambda c: c == 0).count() == 0


def test_shards_are_even_and_groups_stay_together(spark):
    got = queries.op2_label_propagation(spark, SF01).collect()
    count = Counter(r["shard"] for r in got)
    assert sorted(count) == list(range(40)) and max(count.values()) - min(count.values()) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in got:
        groups.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    members = Counter((r["size"], r["text_crc32"]) for r in got)
    shared = [g for g in groups if members[g] > 1]
    assert sum(len(groups[g]) == 1 for g in shared) >= 0.75 * len(shared)


def test_odd_documents_are_sharded(docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "é"), (4, "r"), (4, "r"), (5, "long " * 50_000)]
    rows += [(10 + i, "copied text") for i in range(300)]
    got = S.shard_documents(docs(rows), shards=7).collect()
    assert len(got) == len(rows)
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    size = {r["doc_id"]: r["size"] for r in got}
    assert (size[1], size[2], size[3]) == (16, 16, 18)
    assert len(S.shard_documents(docs(rows[:2]), shards=7).collect()) == 2
    assert S.shard_documents(docs([])).count() == 0


def spark_hash(salt, value, code):
    """xxhash64 of a whole-number column after another, as Spark chains them."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", salt), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack(code, value), seed=h)
    return h - (1 << 64) if h >> 63 else h


def replayed(nodes, links, shards, rounds, slack):
    """Label propagation one round after the other, in plain Python."""
    label = {n: spark_hash(1, n, "<q") % shards for n in nodes}
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    idle = 0
    for r in range(rounds):
        asking = {}
        for u, others in near.items():
            votes = Counter(label[v] for v in others)
            n, _, to = max((n, spark_hash(r, x, "<i"), x) for x, n in votes.items())
            if to != label[u] and spark_hash(100 + r, u, "<q") % 2 == 0 and n > votes.get(label[u], 0):
                asking[u] = to
        moves = Counter((label[u], to) for u, to in asking.items())
        share = {(a, b): x for a, b, x in S.quotas([(*k, n) for k, n in moves.items()], Counter(label.values()),
                                                   len(nodes) / shards * (1 + slack))}
        movers = {u: to for u, to in asking.items() if spark_hash(200 + r, u, "<q") % (1 << 30) / (1 << 30) < share[label[u], to]}
        label |= movers
        idle = 0 if movers else idle + 1
        if idle == S.IDLE:
            break
    return label, r + 1


def test_propagation_replayed(spark):
    rng = random.Random(2)
    nodes = list(range(0, 900, 3))
    links = [(nodes[i], nodes[i - 1 - rng.randrange(3)]) for i in range(5, 200)] + [(nodes[200], n) for n in nodes[201:260]]
    want, rounds = replayed(nodes, links, 5, S.ROUNDS, 0.2)
    assert 3 < rounds < S.ROUNDS
    got = S.propagate(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"), 5, S.ROUNDS, 0.2)
    assert {r.node: r.label for r in got.collect()} == want


def test_propagation_lowers_the_cut(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"))
    links = spark.createDataFrame([(i, i - i % 10) for i in range(400) if i % 10], "a long, b long")
    label = {r["node"]: r["label"] for r in S.propagate(nodes, links, shards=4, rounds=10).collect()}
    cut = sum(label[a] != label[b] for a, b in ((i, i - i % 10) for i in range(400) if i % 10))
    assert cut <= 0.15 * 360


def test_quotas_never_overfill():
    share = {(s, t): p for s, t, p in S.quotas([(0, 1, 10), (1, 0, 4), (2, 1, 6)], {0: 20, 1: 20, 2: 10}, 22.0)}
    assert share[(1, 0)] == 1.0 and abs(share[(0, 1)] - (4 + 6 / 6) / 10) < 1e-9
