import random
import zlib

import numpy as np
import public_tokenizers
from marketlake.llm import packing as P
from tokenizers import Tokenizer

from .texts import sentence

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def corpus():
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a  b\n\n c\t"), (None, "no id"), (5, "same"), (5, "same"),
            (6, "<|endoftext|> is text"), (7, "word " * 1023), (8, "é中\U0001F600" * 400), (9, "x" * 3000)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 900))) for i in range(150)]
    return rows + [(900, sentence(rng, 60_000))]


def test_pieces_cover_every_id_once(docs):
    rows = corpus()
    got = P.pack_documents(docs(rows), VOCABULARY, PATTERN).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    ids = [[*reference.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows]
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for (doc, _), own in zip(rows, ids):
        found = sorted(pieces[(doc, len(own))], key=lambda r: r["start"])
        times = 2 if doc == 5 else 1
        assert sum(r["length"] for r in found) == times * len(own)
        for r in found:
            part = np.array(own[r["start"]:r["start"] + r["length"]], dtype="<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.CAPACITY and len(members) <= P.MAX_SEGMENTS
    total = sum(map(len, ids))
    assert total / (len(sequences) * P.CAPACITY) > 0.97


def test_limits_hold_together(docs):
    got = P.pack_documents(docs(corpus()), VOCABULARY, PATTERN, max_segments=3, max_loss=700).collect()
    load = {}
    for r in got:
        s = load.setdefault(r["sequence_id"], [0, 0, 0])
        s[0] += r["length"]
        s[1] += 1
        s[2] += r["loss_tokens"]
    assert all(t <= 1024 and n <= 3 and loss <= 700 for t, n, loss in load.values())
    assert sum(s[0] for s in load.values()) == sum(r["length"] for r in got)


def test_long_texts_are_sliced_safely():
    ids = P.Ids(VOCABULARY, PATTERN)
    rng = random.Random(9)
    text = sentence(rng, 3000).replace("w7", "\n  w7").replace("w9", "  w9\x1c w")
    whole = ids.of(text)
    ids.SLICE = 64
    assert (ids.of(text) == whole).all() and not len(ids.of(""))


def test_uncut_vectors(spark):
    rng = np.random.RandomState(1)
    limits = {"tokens": 100, "segments": 8, "loss": 60}
    demands = np.stack([rng.randint(1, 60, 400), np.ones(400, int), rng.randint(0, 40, 400)], axis=1)
    demands[0] = (500, 1, 3)  # over a limit alone
    rows = [(i, *map(int, d)) for i, d in enumerate(demands)] + [(400, None, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens int, segments int, loss int")
    got = {r["id"]: r["sequence_id"] for r in P.pack_examples(df, limits).collect()}
    assert sorted(got) == list(range(401))
    load = {}
    for i, s in got.items():
        if 0 < i < 400:
            load.setdefault(s, np.zeros(3))
            load[s] += demands[i]
    assert all((v <= [100, 8, 60]).all() for v in load.values())
    assert list(got.values()).count(got[0]) == 1
    least = max(demands[1:, k].sum() / m for k, m in enumerate(limits.values()))
    assert len(load) <= 1.25 * least + 4


def test_empty_table(docs):
    assert P.pack_documents(docs([]), VOCABULARY, PATTERN).count() == 0


SPECIAL = "<|endoftext|>"


def test_added_tokens_as_the_tokenizer_itself():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = P.Ids(VOCABULARY, PATTERN, P.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    texts = ["", SPECIAL, f"{SPECIAL}{SPECIAL}", f"a {SPECIAL} b", f"a  {SPECIAL}\n\nb", f"<|endof{SPECIAL}text|>",
             f"x{SPECIAL}", f"  {SPECIAL}  ", "<|endoftext|", "no such token", f"don{SPECIAL}'t é {SPECIAL}中",
             f"a b {SPECIAL} c d{SPECIAL} " * 100]
    for cut in (ids.SLICE, 8):
        ids.SLICE = cut
        for t in texts:
            assert ids.of(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_query_and_pipeline_ids_hold_added_tokens(spark, docs, tmp_path):
    import corpus_pipeline
    from marketlake.llm.queries import op3_vector_packing
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, f"one {SPECIAL} two"), (2, "plain text"), (3, None)]
    docs(rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    expect = {}
    for doc, t in rows:
        own = np.array([*reference.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expect[doc] = (len(own), zlib.crc32(own.tobytes()))
    for got in (op3_vector_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs(rows), "")):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in got.collect()} == expect
