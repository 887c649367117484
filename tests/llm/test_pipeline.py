import random
import tempfile

import corpus_pipeline as P
from marketlake.llm.common import table
from marketlake.llm.near_jaccard import jaccard_components

from .texts import sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark):
    """Good documents with copies and near copies, junk, and labels for a part of them."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        text = sentence(rng, rng.randrange(40, 160), 5000)
        if i % 4 == 0:
            text = " ".join(w + "&&&" for w in text.split())
        rows.append((i, text, None, f"src{i % 5}" if i % 3 else "hot", None))
        if i % 2 == 0:
            labels.append((i, int(i % 4 != 0), 0))
    good = [r for r in rows if r[0] % 4][:30]
    rows += [(300 + k, r[1].replace(" ", "  "), None, r[3], None) for k, r in enumerate(good)]
    rows += [(400 + k, r[1] + " one more", None, r[3], None) for k, r in enumerate(good)]
    labels += [(1, None, None), (2, 1, 0), (2, 0, 0), (None, 1, 0)]
    path = tempfile.mkdtemp(prefix="corpus-test-", dir="/tmp")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_one_by_one(spark, scratch):
    path, rows = folder(spark)
    docs = table(spark, path, "documents")
    out = {}
    for k, (name, stage) in enumerate(P.STAGES):
        after = stage(spark, docs, path)
        if name != "packing":
            assert after.columns == docs.columns
        after.write.parquet(f"{scratch}/{k}")
        docs = out[name] = spark.read.parquet(f"{scratch}/{k}")
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in out.items()}
    assert set(ids["quality"]) == {r[0] for r in rows if r[0] % 4 or r[0] >= 300}
    copies = [r[0] for r in rows if 300 <= r[0] < 400]
    # of a text and its copy with more white space, the longer original stays
    assert set(copies) <= set(ids["exact_dedup"]) and len(ids["exact_dedup"]) == len(ids["quality"]) - len(copies)
    groups = {r["doc_id"]: r["component_id"] for r in jaccard_components(out["exact_dedup"]).collect()}
    assert sorted(ids["near_dedup"]) == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)
    assert set(ids["mix_sources"]) <= set(ids["near_dedup"]) and max(map(ids["mix_sources"].count, ids["mix_sources"])) <= 3
    assert set(ids["packing"]) == set(ids["mix_sources"])


def test_run_and_empty_documents(spark):
    path, _ = folder(spark)
    out = P.run(spark, path)
    assert "sequence_id" in out.columns and out.count() > 0
    empty = tempfile.mkdtemp(prefix="corpus-test-", dir="/tmp")
    table(spark, path, "documents").limit(0).write.parquet(f"{empty}/documents.parquet")
    table(spark, path, "labels").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert P.run(spark, empty).count() == 0
