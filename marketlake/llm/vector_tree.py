"""Operator 9: nearest neighbours by a hierarchical k-means tree, best bin first.

Nearness is the largest inner product. Vectors are mapped to a distance once:
with one more component sqrt(M^2 - |x|^2), M the largest norm, the nearest
neighbour of (q, 0) is the one of largest inner product; the tree is built there.

Index: the tree is fitted on at most ``sample_rows`` vectors, drawn by a seeded hash
(documented bound), with ``branch`` children a node and leaves of about
``leaf_sample`` sample vectors; every vector of the table is then assigned to a leaf.
Search: a query walks the tree with a priority queue of nodes by distance to their
centre, and visits the leaves in the order they leave the queue. How many leaves it
visits is calibrated: on ``calibration`` distinct sample queries (half of them of large norm), brute force over the sample
gives the true neighbours, and visits widen until the mean recall reaches ``target`` and nearly all queries
``LEAST_RECALL``. Whatever the calibration says, a query goes on until its leaves hold
more than k rows, so it gets k neighbours wherever there are as many candidates.

On the cluster: leaves are split into blocks of at most about ``block`` rows by hash,
so a leaf (or one vector) that holds a third of the rows is many tasks; each (query, leaf)
visit joins the leaf's blocks, a block keeps its best k a query, and the best k
over all blocks come from a bounded per-query merge. Scores are double precision
sums in component order, the same for equal vectors, so ties fall to the smaller id.

Defined results: null, empty, zero, null-holding or non-finite vectors take no part,
nor vectors whose length is not the most common one (the smallest on ties); repeated
rows are candidates of their own; a query is never its own candidate (same id);
fewer than k candidates give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import durable, received, sent

SAMPLE_ROWS = 20_000
LEAF_SAMPLE = 48
BRANCH = 12
CALIBRATION = 200
TARGET = 0.97
LEAST_RECALL = 0.9
SURE_SHARE = 0.95
BLOCK = 2048
MAX_QUERIES = 512
CHUNK = 256


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)``, double components, only the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
                      & F.exists("v", lambda x: x != 0.0))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "d").limit(1).select("d")
    return rows.where(F.size("v") == usual.scalar())


class Tree:
    """Flat arrays: centres, children and leaf numbers; small enough for every task."""

    def __init__(self, x: np.ndarray, branch: int, leaf_rows: int, seed: int = 11):
        self.rng = np.random.RandomState(seed)
        self.centres: list[np.ndarray] = [x.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.n_leaves = 0
        self._split(0, x, branch, leaf_rows)
        self.centres_ = np.stack(self.centres)

    def _split(self, node: int, x: np.ndarray, branch: int, leaf_rows: int) -> None:
        k = min(branch, max(2, len(x) // leaf_rows))
        parts = self._kmeans(x, k) if len(x) > leaf_rows else []
        if len(parts) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return
        for centre, rows in parts:
            kid = len(self.centres)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(kid)
            self._split(kid, rows, branch, leaf_rows)

    def _kmeans(self, x: np.ndarray, k: int, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = np.argmin((c ** 2).sum(1) - 2 * x @ c.T, axis=1)
            c = np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        near = np.argmin((c ** 2).sum(1) - 2 * x @ c.T, axis=1)
        return [(c[j], x[near == j]) for j in range(k) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every level."""
        out = np.empty(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres_[kids]
            near = np.argmin((c ** 2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            todo += [(kids[j], rows[near == j]) for j in range(len(kids)) if (near == j).any()]
        return out

    def visits(self, q: np.ndarray, most: int, rows: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones until they hold ``enough`` of the ``rows`` a leaf has."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or rows is not None and held < enough):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += 0 if rows is None else int(rows[self.leaf[node]])
                continue
            far = ((self.centres_[kids] - q) ** 2).sum(axis=1)
            for d, kid in zip(far.tolist(), kids):
                heapq.heappush(queue, (d, kid))
        return out


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with the component that makes all norms ``norm``."""
    rest = np.sqrt(np.maximum(0.0, norm ** 2 - (x ** 2).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in component order."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += q[j] * x[:, j]
    return out


def calibrated_visits(tree: Tree, x: np.ndarray, lift: np.ndarray, k: int, target: float, queries: int) -> int:
    """The least number of visits (in steps of a fifth) with which the sample's queries reach ``target``.

    Half of the queries come from all vectors, half from those of the largest norms, which many look for. Either
    half must reach it in the mean, and ``SURE_SHARE`` of its queries ``LEAST_RECALL``, so that those whose
    neighbours are easy to find do not speak for the others. ``x`` has distinct vectors: copies of a query would
    all be found at once.
    """
    leaves = tree.assign(lift)
    half = max(1, queries // 2)
    large = np.argsort((x ** 2).sum(axis=1), kind="stable")[-max(half, len(x) // 20):]
    spread = lambda n: np.linspace(0, n - 1, min(half, n)).astype(int)
    picks = np.concatenate([spread(len(x)), large[spread(len(large))]])
    zero = np.zeros(1)
    need = []
    for i in picks:
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s, kind="stable")[:min(k, len(x) - 1)]
        order = {leaf: r for r, leaf in enumerate(tree.visits(np.append(x[i], zero), tree.n_leaves))}
        need.append(sorted(order[v] + 1 for v in leaves[top]))
    n = 1
    while n < tree.n_leaves:
        found = np.array([sum(1 for v in one if v <= n) / max(1, len(one)) for one in need])
        if all(part.mean() >= target and (part >= LEAST_RECALL).mean() >= SURE_SHARE for part in np.split(found, [len(spread(len(x)))])):
            break
        n = n + max(1, n // 5)
    return min(n, tree.n_leaves)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS, target: float = TARGET) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query``, its k nearest found."""
    rows = durable(usable(vectors, id_col, vec_col))
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    shape = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    if not seen["n"]:
        return spark.createDataFrame([], shape)
    drawn = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(sample_rows).select("v").collect()
    x = np.unique(np.array([r["v"] for r in drawn]), axis=0)
    norm = float(seen["norm"])
    lift = lifted(x, norm)
    tree = Tree(lift, BRANCH, LEAF_SAMPLE)
    # a leaf of the table holds more near rows than one of the sample, so the sample's count errs on the wide side
    n_visits = calibrated_visits(tree, x, lift, k, target, CALIBRATION)
    model = sent(spark, (tree, norm, n_visits))

    def assigned(batches):
        tree, norm, _ = received(model)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=tree.assign(lifted(np.array(pdf["v"].tolist()), norm)))

    def walked(batches):
        tree, _, n_visits = received(model)
        for pdf in batches:
            leaves = [tree.visits(np.append(v, 0.0), n_visits, held, k + 1) for v in pdf["v"]]
            size = [len(x) for x in leaves]
            yield pd.DataFrame({"query_id": pdf["vec_id"].repeat(size).to_numpy(),
                                "q": pdf["v"].repeat(size).to_numpy(),
                                "leaf": [y for x in leaves for y in x]})

    index = durable(rows.mapInPandas(assigned, f"vec_id {id_type}, v array<double>, leaf long"))
    counts = durable(index.groupBy("leaf").agg(F.count("*").alias("n")))
    held = np.zeros(tree.n_leaves, dtype=np.int64)
    for r in counts.collect():  # a row a leaf of the bounded tree
        held[r["leaf"]] = r["n"]
    sizes = counts.select("leaf", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    index = index.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = rows.where(is_query(F.col("vec_id"))).mapInPandas(walked, f"query_id {id_type}, q array<double>, leaf long")
    # a leaf's visitors in parts of bounded expected size: no more than the rows over MAX_QUERIES
    asked = durable(asked.join(sizes, "leaf").withColumn("part", F.pmod(
        F.xxhash64("query_id"), F.lit(1) + F.floor(F.lit(seen["n"]) / F.lit(20 * MAX_QUERIES))).cast("int")))
    parts = asked.groupBy("leaf", "part").agg(F.first("blocks").alias("blocks")).select(
        F.col("leaf").alias("at_leaf"), F.col("part").alias("of_part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at_block"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = index.join(parts, (F.col("leaf") == F.col("at_leaf")) & (F.col("block") == F.col("at_block")))
    blocks = blocks.select("at_leaf", "at_block", "of_part", "vec_id", "v")

    def compared(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(part):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = part.sort_values("vec_id", kind="stable")
        ids, v = part["vec_id"].to_numpy(), np.array(part["v"].tolist())
        q_ids, chosen, values = [], [], []
        longest = np.sqrt((v ** 2).sum(axis=1).max())
        for at in range(0, len(queries), CHUNK):
            some = queries.iloc[at:at + CHUNK]
            q = np.array(some["q"].tolist())
            rough = q @ v.T
            # all rows that rounding may put among the k nearest, then the exact sums and order
            least = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(v) > k + 1 else np.full(len(q), -np.inf)
            slack = 1e-12 * len(q[0]) * longest * np.sqrt((q ** 2).sum(axis=1))
            near = rough >= (least - slack)[:, None]
            for q_id, x, hit in zip(some["query_id"], q, near):
                rows = np.flatnonzero(hit)
                rows = rows[ids[rows] != q_id]
                s = scores(x, v[rows])
                best = np.argsort(-s, kind="stable")[:k]
                q_ids += [q_id] * len(best)
                chosen.append(ids[rows[best]])
                values.append(s[best])
        return pd.DataFrame({"query_id": q_ids, "vec_id": np.concatenate(chosen), "score": np.concatenate(values)})

    found = asked.select("leaf", "block", "part", "query_id", "q").groupBy("leaf", "block", "part").cogroup(
        blocks.groupBy("at_leaf", "at_block", "of_part")).applyInPandas(
        compared, f"query_id {id_type}, vec_id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(vectors: DataFrame, query_ids: list, k: int, id_col: str = "vec_id",
                vec_col: str = "embedding") -> DataFrame:
    """The true neighbours of a bounded list of queries, for measuring recall."""
    rows = usable(vectors, id_col, vec_col)
    asked = rows.where(F.col("vec_id").isin(query_ids)).collect()
    known = rows.sparkSession.sparkContext.broadcast([(r["vec_id"], np.array(r["v"])) for r in asked])
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def near(batches):
        for pdf in batches:
            ids = pdf["vec_id"].to_numpy()
            v = np.array(pdf["v"].tolist()) if len(pdf) else None
            for q_id, q in known.value if len(pdf) else ():
                s = scores(q, v)
                at = np.lexsort((ids, -s))
                at = at[ids[at] != q_id][:k]
                yield pd.DataFrame({"query_id": [q_id] * len(at), "vec_id": ids[at], "score": s[at]})

    found = rows.mapInPandas(near, f"query_id {id_type}, vec_id {id_type}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of true neighbours found; a row as near as the last true one counts."""
    last = truth.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    hit = found.join(last, "query_id").where(F.col("score") >= F.col("last")).count()
    return hit / max(1, truth.count())
