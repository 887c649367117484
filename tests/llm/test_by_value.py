"""The operators run where the workers cannot import the package."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import os, sys, tempfile
sys.path.insert(0, {root!r})  # the driver's path only: workers get the environment's
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def absent(batches):
    import importlib.util
    for pdf in batches:
        assert importlib.util.find_spec("marketlake") is None
        yield pdf
spark.range(3).mapInPandas(absent, "id long").collect()
from marketlake.llm import word_pieces as W, vector_tree as V, spelling as S, collocations as C, url_filter as U
docs = spark.createDataFrame([(i, "the cat sat on the mat", "en") for i in range(40)], "doc_id long, text string, lang string")
print(W.count_pieces(docs, ["the", "c", ""], ["at", "s", "o", "n", "m", "a", "t"]).count())
vec = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
print(V.nearest(vec, lambda i: i % 20 == 0).count())
print(S.spelling_variants(S.word_counts(docs, least=3)).count(), C.collocations(docs).count())
pages = spark.createDataFrame([(1, "http://a.com/x", "<p>hi</p>")], "page_id long, url string, html string")
print(U.judge_urls(pages, [("block", "com/")]).count())
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[:3] == ["40", "60", "4"]
