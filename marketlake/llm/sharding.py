"""Operator 2: sharding linked documents by balanced label propagation.

Every document starts in a shard by a hash of its id. In each round a document looks
at its neighbours' shards (a join of links and labels, counted per document and
shard by partial aggregation) and asks to move to the commonest. A seeded half of the
documents may ask in a round, which breaks the swapping of pairs. Between two shards
as many may move one way as the other; beyond that only the room that the target's
quota (the even share plus ``slack``) leaves is dealt out, in proportion, to seeded
shares of those who ask. Cut links fall while sizes stay near even. It ends when nobody
has moved for ``IDLE`` rounds (everybody has been asked by then, but for one in eight), after ``ROUNDS`` at
the latest.

At the end sizes are made exactly even (counts at most one apart): documents are
numbered in the order of shard, then group, and the numbers are cut into equal runs,
so only documents at the at most shards - 1 cuts change shard.

Scale: a round moves ids and shard numbers only; a hub's neighbours are summed where
they are. The final numbers are built in two levels, bucket counts and places in a
bucket of about ``BUCKET_ROWS`` rows; a group larger than a bucket is spread over
several by hash. The driver sees the table of moves between shards, at most shards
squared rows.

Defined results: a null text has no bytes and belongs to the group of empty texts; repeated rows and null ids
are rows of their own; more shards than rows leaves shards empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import durable, text_or_empty

SHARDS = 40
ROUNDS = 60
IDLE = 3
SLACK = 0.2
BUCKET_ROWS = 2048


def group_links(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Links of a star: each member of a group with the group's smallest node, not all pairs."""
    hubs = durable(nodes.groupBy(*key).agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"))
    return nodes.join(hubs, key).where("node <> b").select(F.col("node").alias("a"), "b")


def quotas(moves: list[tuple[int, int, int]], sizes: dict[int, int], most: float) -> list[tuple[int, int, float]]:
    """The share of those asking to go from s to t that may: balanced swaps plus t's free room."""
    asked = {(s, t): n for s, t, n in moves}
    swap = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    beyond: dict[int, int] = {}
    for (s, t), n in asked.items():
        beyond[t] = beyond.get(t, 0) + n - swap[(s, t)]
    out = []
    for (s, t), n in asked.items():
        room = max(0.0, most - sizes.get(t, 0))
        share = min(1.0, room / beyond[t]) if beyond[t] else 0.0
        out.append((s, t, (swap[(s, t)] + share * (n - swap[(s, t)])) / n))
    return out


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS,
              slack: float = SLACK) -> DataFrame:
    """``(node, label)``: near-even shards of few cut links. ``links``: ``(a, b)`` node pairs."""
    spark = nodes.sparkSession
    both = durable(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = durable(nodes.select("node", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(shards)).cast("int").alias("label")))
    total = labels.count()
    most = total / shards * (1 + slack)
    idle = 0
    for r in range(rounds):
        votes = both.join(labels, both.v == labels.node).groupBy("u", "label").agg(F.count("*").alias("votes"))
        tie = F.xxhash64(F.lit(r), "label")
        best = votes.groupBy("u").agg(F.max(F.struct("votes", tie.alias("tie"), "label")).alias("best"))
        own = labels.withColumnRenamed("label", "own")
        asking = best.join(own, best.u == own.node).where(
            (F.col("best.label") != F.col("own")) & (F.pmod(F.xxhash64(F.lit(100 + r), "node"), F.lit(2)) == 0))
        asking = durable(asking.join(votes.select(F.col("u").alias("x"), F.col("label").alias("y"),
                                                  F.col("votes").alias("stay")),
                                     (F.col("u") == F.col("x")) & (F.col("own") == F.col("y")), "left")
                         .where(F.col("best.votes") > F.coalesce("stay", F.lit(0)))
                         .select("node", "own", F.col("best.label").alias("to")))
        moves = [tuple(m) for m in asking.groupBy("own", "to").count().collect()]
        if not moves:
            idle += 1
            if idle == IDLE:
                break
            continue
        sizes = {m["label"]: m["count"] for m in labels.groupBy("label").count().collect()}
        allowed = spark.createDataFrame(quotas(moves, sizes, most), "own int, to int, share double")
        draw = F.pmod(F.xxhash64(F.lit(200 + r), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        moved = durable(asking.join(allowed, ["own", "to"]).where(draw < F.col("share")).select(
            F.col("node").alias("mover"), "to"))
        idle = 0 if moved.limit(1).count() else idle + 1
        if idle == IDLE:
            break
        labels = durable(labels.join(moved, labels.node == moved.mover, "left").select(
            "node", F.coalesce("to", "label").alias("label")))
    return labels


def even_out(rows: DataFrame, total: int, shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot``. ``rows``: ``node, label, h1, h2, group_size`` and more."""
    bits = max(0, (max(1, total // (shards * bucket_rows))).bit_length())
    top = F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")
    spread = F.when(F.col("group_size") > bucket_rows, 1 + F.pmod(
        F.xxhash64("node"), F.ceil(F.col("group_size") / F.lit(bucket_rows)))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("top", top).withColumn("spread", spread)
    key = ["label", "top", "spread"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("label").orderBy("top", "spread").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("n").over(inside))
    labels = counts.groupBy("label").agg(F.sum("n").alias("n_label"))  # one row per shard
    ahead = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    labels = labels.select("label", (F.sum("n_label").over(ahead) - F.col("n_label")).alias("ahead"))
    counts = counts.join(labels, "label").select(*key, (F.col("ahead") + F.col("upto") - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("h1", "h2", "node")) - 1
    rank = F.col("base") + F.col("place")
    out = rows.join(counts, key).withColumn("place", place).withColumn("rank", rank)
    # whole-number division: shard s holds the ranks from ceil(s * total / shards) on
    out = out.withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(1, total)} as int)"))
    return out.withColumn("slot", F.expr(f"rank - (cast(shard as long) * {total} + {shards - 1}) div {shards}"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Documents of equal texts are linked; the law is ``rows``.
    """
    text = text_or_empty(F.col(text_col))
    nodes = durable(docs.select(
        F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(3), text).alias("h2")))
    key = ["h1", "h2", "size"]
    labels = propagate(nodes, group_links(nodes, key), shards, rounds, slack)
    groups = durable(nodes.groupBy(*key).agg(F.count("*").alias("group_size")))
    rows = nodes.join(labels, "node").join(groups, key)
    return even_out(rows, nodes.count(), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
