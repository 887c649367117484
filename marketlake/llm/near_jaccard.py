"""Operator 10: n-gram Jaccard join by parity sketches.

Two documents link when 100 |A n B| >= 75 |A u B| for their sets of five-word
shingles. Then |A ^ B| <= d = floor((|A| + |B|) / 7).

1. Sets with equal members are one class, named by a 64-bit fingerprint of the set; a second
   one tells whether two sets ever share a name. A class's text is that of its first row, by id
   and text, so ids that repeat or are missing move no text twice. Copies are not keyed: a bitmap of fixed
   size (2 MB) of the first rows tells tasks so; what it wrongly lets through is a repeated key.
2. Pigeonhole join of parity sketches per size band. A band has its own number of
   parts; a set is dealt to the parts by hash, and a part's 64-bit word is the XOR
   of its members, so at most d words of a linked pair differ. With the occupied
   parts in one fixed order, the first d + l of both documents share l equal words
   (prefix argument), for the largest d a partner may need. A document is keyed in
   its own band and, where a smaller partner may lie there, in the band below.
   A document emits l = 1 + slack such keys.
3. A key held by more than ``HOT`` classes is hot. A document with no more hot keys
   than its slack shares another key with each partner, so its hot keys add
   nothing. The heavy others (members of large near-copy groups, texts full of common
   passages) only still need each other: they are keyed again, by the rarest d + 1 of
   all their words, counted among the heavy ones.
4. Links are found in two rounds, for the result needs connectedness, not all
   pairs of a group. First each member against its bucket's most central member; then,
   in the buckets that still hold several components, the pairs across components,
   by an equi-join that evaluates a 512-bit sketch's bound inside itself.
5. A candidate pair must pass its full sketch's lower bound (Hamming distance <= d,
   at four bits or more a member) before its sets are moved, and is then verified
   exactly on the sets.

No cap drops a candidate. Links are exact up to equal 64-bit hashes of shingles and sets, and
the prefix argument needs d + 1 occupied parts: sets of up to ``FEW`` shingles have a part for each
member, larger ones so many parts that fewer than d + 1 of them do not occur.

Defined results: null or wordless text has an empty set, is linked with nothing
and is its own component; fewer than five words make one shingle; rows that repeat
a text share a class; a null doc_id counts as larger than any other when the
smallest id is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, release, text_or_empty, with_text_id
from .components import connected_components
from .line_dedup import hash_bits
from .shingles import fingerprint, fold_to, parity_sketch, parity_words, shingle_set, signed

HOT = 8
WORDS = 5
FEW = 24
SHORT = [f"s{i}" for i in range(8)]  # a 512-bit sketch as eight numbers
FLUSH_ROWS = 200_000


def largest_partner(n: int) -> int:
    return 4 * n // 3


def slack(n: int) -> int:
    return 2 * n // 25


def prefix_length(n: int) -> int:
    return (n + largest_partner(n)) // 7 + 1 + slack(n)


def parts_for(n: int) -> int:
    """The number of parts of a pair whose smaller set has ``n`` members."""
    if n <= FEW:  # every member in a part of its own: a few members may fall into one of a few parts
        return 1 << 24
    least = n if n < 200 else 0.6 * n
    return max(64, 1 << math.ceil(math.log2(max(1.0, least))))


def bands(n: int) -> list[int]:
    """The parts a set of ``n`` is keyed with: for smaller and for larger partners."""
    least = -(-3 * n // 4)
    return sorted({parts_for(m) for m in (least, n)} | {
        parts_for(m) for m in (FEW, FEW + 1, 199, 200) if least <= m <= n})


def sketch_bits(n: int) -> int:
    return max(64 * len(SHORT), 1 << math.ceil(math.log2(4 * max(1, n))))


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The class, sketches and size of each text; ``text_hash`` passes through."""
    for pdf in batches:
        out, short = [], np.zeros((len(pdf), len(SHORT)), dtype=np.int64)
        for i, text in enumerate(pdf["text"]):
            s = shingle_set(text, WORDS)
            sketch = parity_sketch(s, sketch_bits(len(s)))
            short[i] = fold_to(sketch, 8 * len(SHORT)).view("<i8")
            out.append((len(s), *fingerprint(s), sketch.tobytes()))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"],
                            "n": [r[0] for r in out], "class": [r[1] for r in out],
                            "check": [r[2] for r in out], "sketch": [r[3] for r in out]}
                           | {k: short[:, i] for i, k in enumerate(SHORT)})


class _Keys:
    """Collects key rows and hands them out in frames of bounded size."""

    def __init__(self, first_only: bool):
        self.first_only = first_only
        self.clear()

    def clear(self) -> None:
        self.keys: list[np.ndarray] = []
        self.about: list[tuple[int, int, int, int]] = []
        self.rows = 0

    def add(self, c: int, s: np.ndarray) -> None:
        for parts in bands(len(s)):
            k = parity_words(s, parts, prefix_length(len(s)) if self.first_only else len(s))
            self.keys.append(k)
            self.about.append((c, len(s), parts.bit_length() - 1, len(k)))
            self.rows += len(k)

    def frame(self) -> pd.DataFrame:
        about = np.array(self.about, dtype=np.int64).reshape(-1, 4)
        out = {"key": np.concatenate(self.keys).view(np.int64) if self.keys else np.zeros(0, np.int64),
               "class": np.repeat(about[:, 0], about[:, 3])}
        if self.first_only:  # size and band share a column: this is the widest shuffle
            out["tag"] = np.repeat((about[:, 1] * 64 + about[:, 2]).astype(np.int32), about[:, 3])
        else:
            out |= {k: np.repeat(about[:, i].astype(np.int32), about[:, 3])
                    for k, i in (("n", 1), ("band", 2), ("occupied", 3))}
        self.clear()
        return pd.DataFrame(out)


def _keyed(firsts):
    """Keys of the texts whose row may be its class's first; ``firsts`` broadcasts a bit for each first row's hash."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, seen = _Keys(first_only=True), set()
        bits = firsts.value.view(np.uint64)
        for pdf in batches:
            at = pdf["row_hash"].to_numpy(dtype=np.int64).view(np.uint64) & np.uint64(64 * len(bits) - 1)
            first = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            for text in pdf["text"].to_numpy()[first]:
                s = shingle_set(text, WORDS)
                c = fingerprint(s)[0]
                if len(s) and c not in seen:  # a copy of a class this task has just keyed adds nothing
                    seen.add(c)
                    keys.add(c, s)
                if keys.rows >= FLUSH_ROWS:
                    yield keys.frame()
                    seen = set()
        yield keys.frame()
    return keyed


def _all_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = _Keys(first_only=False)
    for pdf in batches:
        for c, text in zip(pdf["class"], pdf["text"]):
            s = shingle_set(text, WORDS)
            if fingerprint(s)[0] == c:  # another text may share the document's id
                keys.add(c, s)
            if keys.rows >= FLUSH_ROWS:
                yield keys.frame()
    yield keys.frame()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_set(t, WORDS) for t in pdf["text"]]
        own = [fingerprint(s)[0] == c for s, c in zip(sets, pdf["class"])]  # another text may share the document's id
        yield pd.DataFrame({"class": pdf["class"][own], "members": pd.Series(
            [s.tobytes() for s, ok in zip(sets, own) if ok], dtype=object, index=pdf.index[own])})


def _near_sketches(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    out = []
    for x, y, most in zip(a, b, limit):
        p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
        size = min(len(p), len(q))
        out.append(int(np.bitwise_count(fold_to(p, size) ^ fold_to(q, size)).sum()) <= most)
    return pd.Series(out, dtype=bool)


def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate((p, q))
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        out.append(100 * inter >= 75 * (len(p) + len(q) - inter))
    return pd.Series(out, dtype=bool)


def row_hash(doc_id: str, text_hash: Column | str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_hash)


def first_row() -> Column:
    """Orders rows by id, those without one last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def fits(a: Column, b: Column) -> Column:
    """The sizes allow a similarity of 0.75."""
    return (F.least(a, b) * 4 >= F.greatest(a, b) * 3)


class JaccardJoin:
    """The join's stages over one input; see the module's text."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        text = text_or_empty(F.col(text_col)).cast("binary")
        as_text, kind = with_text_id(docs, id_col, text)
        self.docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        as_text = as_text.withColumn("text_hash", F.xxhash64("text"))
        rows = as_text.mapInPandas(_described, "doc_id string, text_hash long, n long, class long, check long, sketch binary, "
                                   + ", ".join(f"{k} long" for k in SHORT))
        self.rows = durable(rows.withColumn("doc_id", F.col("doc_id").cast(kind)))
        self.classes = durable(self.rows.where("n > 0").groupBy("class").agg(
            F.min(first_row()).alias("rep"), F.first("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
            .select("class", F.col("rep.doc_id").alias("first_id"), F.col("rep.text_hash").alias("first_hash"), "n", "lo", "hi"))
        clash = self.classes.where("lo <> hi").select("class").first()
        if clash:  # two halves of 64 bits: never seen, and never passed over
            raise ValueError(f"two different sets share the fingerprint {clash[0]}")

    def buckets(self) -> DataFrame:
        """``(key, class, n, band, size)`` of every key that several classes hold."""
        firsts = self.docs.sparkSession.sparkContext.broadcast(hash_bits(
            self.classes.select(row_hash("first_id", "first_hash").alias("line"))))
        rows = self.docs.select("text", row_hash("doc_id", F.xxhash64("text")).alias("row_hash"))
        keyed = rows.mapInPandas(_keyed(firsts), "key long, class long, tag int")
        of = Window.partitionBy("key").orderBy("class")
        rows = keyed.repartition("key").withColumn("before", F.lag("class").over(of))
        rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col("class")))
        rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("key")))
        n = F.floor(F.col("tag") / 64).cast("int")
        return durable(rows.where("size > 1").select("key", "class", n.alias("n"), (F.col("tag") % 64).alias("band"), "size"))

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """``(class, text)`` of the given classes."""
        ids = classes.join(self.classes, "class").select("class", F.col("first_id").alias("id"), "first_hash")
        keyed = self.docs.withColumn("text_hash", F.xxhash64("text"))
        return keyed.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("first_hash"))
                          ).select("class", "text")

    def rare_buckets(self, heavy: DataFrame) -> DataFrame:
        """Buckets of the heavy classes among themselves, by their rarest words.

        Two of them share all but d of their occupied parts' words. With the words in
        order of how many heavy classes hold them, the d + 1 rarest of both have one
        in common; words that one class holds alone are the rarest and pair nothing.
        """
        keys = durable(self.texts_of(heavy).mapInPandas(
            _all_keys, "key long, class long, n int, band int, occupied int").distinct())
        release(keys.sparkSession)
        sizes = durable(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        own = Window.partitionBy("class", "band")
        rows = keys.join(sizes, "key").withColumns({
            "place": F.row_number().over(own.orderBy("size", "key")), "shared": F.count("*").over(own)})
        d = F.floor((F.col("n") + F.floor(F.col("n") * 4 / 3)) / 7)
        rows = rows.where(F.col("place") <= d + 1 - (F.col("occupied") - F.col("shared")))
        return rows.select("key", "class", "n", "size")

    def useful(self, buckets: DataFrame) -> DataFrame:
        """``(key, class, n, weight)``: the small buckets, and the heavy classes' rare ones.

        ``weight`` says how common a class's words are: the centre of a group of near
        copies has the largest.
        """
        least = F.floor(F.floor(F.col("n") * 3 / 4) * 2 / 25)
        hot = buckets.where(F.col("size") > HOT).groupBy("class", "band").agg(
            F.count("*").alias("hot"), F.first("n").alias("n"))
        heavy = durable(hot.where(F.col("hot") > least).select("class").distinct())
        weight = buckets.groupBy("class").agg((F.sum("size") / F.first("n")).alias("weight"))
        small = buckets.where(F.col("size") <= HOT).select("key", "class", "n", "size")
        rows = small.union(self.rare_buckets(heavy)).join(weight, "class")
        return durable(rows.select("key", "class", "n", "weight"))

    def first_pairs(self, buckets: DataFrame) -> DataFrame:
        """Each member with the most central member of its bucket."""
        lead = buckets.groupBy("key").agg(F.max(F.struct("weight", "class", "n")).alias("lead"))
        pairs = buckets.join(lead, "key").where(
            (F.col("class") != F.col("lead.class")) & fits(F.col("n"), F.col("lead.n")))
        return pairs.select(F.least("lead.class", "class").alias("a"),
                            F.greatest("lead.class", "class").alias("b")).distinct()

    def rest_pairs(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs across components, of the buckets that hold several, within the short sketch's bound.

        A bucket's largest component is not compared inside itself: one side of each
        pair comes from the other components. The bound is part of the join, so it
        emits near pairs only.
        """
        lab = labels.select(F.col("node").alias("class"), "label")
        rows = buckets.join(lab, "class", "left").select(
            "key", "class", "n", F.coalesce("label", "class").alias("comp"))
        parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
        mixed = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"),
                                         F.count("*").alias("comps")).where("comps > 1")
        rows = rows.join(mixed.select("key", F.col("top.comp").alias("top")), "key")
        short = self.rows.where("n > 0").dropDuplicates(["class"]).select("class", *SHORT)
        rows = durable(rows.join(short, "class"))
        x, y = rows.where("comp <> top").alias("x"), rows.alias("y")
        far = sum((F.bit_count(F.col(f"x.{k}").bitwiseXOR(F.col(f"y.{k}"))) for k in SHORT), F.lit(0))
        found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
                       & fits(F.col("x.n"), F.col("y.n"))
                       & (far * 7 <= F.col("x.n") + F.col("y.n")))
        return found.select(F.least("x.class", "y.class").alias("a"),
                            F.greatest("x.class", "y.class").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked: sketch bound first, then the exact sets."""
        near = F.pandas_udf(_near_sketches, "boolean")
        linked = F.pandas_udf(_linked, "boolean")
        of = self.rows.where("n > 0").groupBy("class").agg(
            F.first("sketch").alias("sketch"), F.first("n").alias("n"))
        a = of.toDF("a", "sketch_a", "n_a")
        b = of.toDF("b", "sketch_b", "n_b")
        kept = pairs.join(a, "a").join(b, "b").where(
            near("sketch_a", "sketch_b", F.floor((F.col("n_a") + F.col("n_b")) / 7))).select("a", "b")
        kept = durable(kept)
        release(kept.sparkSession)

        wanted = kept.select(F.col("a").alias("class")).union(kept.select("b")).distinct()
        sets = self.texts_of(wanted).mapInPandas(_sets, "class long, members binary")
        sets = durable(sets.dropDuplicates(["class"]))
        release(kept.sparkSession)
        found = kept.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return durable(found.where(linked("set_a", "set_b")).select("a", "b"))

    def components(self) -> DataFrame:
        """``(node, label)`` of every class that has a link."""
        spark = self.docs.sparkSession
        found = self.buckets()
        release(spark)
        buckets = self.useful(found)
        links = self.verified(self.first_pairs(buckets))
        release(spark)
        labels = connected_components(links)
        more = self.verified(self.rest_pairs(buckets, labels))
        release(spark)
        return connected_components(links.union(more))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per input row."""
    join = JaccardJoin(docs, id_col, text_col)
    named = with_components(join)
    return join.rows.withColumn("of", F.when(F.col("n") > 0, F.col("class"))).join(named, "of", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("rep.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_components(join: JaccardJoin) -> DataFrame:
    """``(of, rep)``: every class with its component's first row."""
    named = join.classes.join(join.components(), F.col("class") == F.col("node"), "left").select(
        "class", F.struct(F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("doc_id"),
                          F.col("first_hash").alias("text_hash")).alias("own"),
        F.coalesce("label", "class").alias("comp"))
    first = durable(named.groupBy("comp").agg(F.min("own").alias("rep")))
    return named.join(first, "comp").select(F.col("class").alias("of"), "rep")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component's rows the first stays, by id (none comes last), then text; rows without words stay.

    A row goes by its id and text together, so others that share its id, or have none either, stay.
    Of rows that repeat the id and text that stays, one stays.
    """
    join = JaccardJoin(docs, id_col, text_col)
    rows = join.rows.where("n > 0").join(with_components(join), F.col("class") == F.col("of"))
    rows = rows.groupBy("doc_id", "text_hash", "rep").agg(F.count("*").alias("m"))
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    rows = durable(rows.select("doc_id", "text_hash", is_rep.alias("stays"), "m").where("m > 1 or not stays"))
    key = ["__nj_id", "__nj_hash"]
    keyed = docs.withColumns({key[0]: F.col(id_col), key[1]: F.xxhash64(text_or_empty(F.col(text_col)).cast("binary"))})

    def of(some: DataFrame, how: str) -> DataFrame:
        x = some.select(F.col("doc_id").alias("__nj_x"), F.col("text_hash").alias("__nj_y"))
        return keyed.join(x, F.col(key[0]).eqNullSafe(F.col("__nj_x")) & (F.col(key[1]) == F.col("__nj_y")), how)

    out = of(rows, "left_anti")
    again = rows.where("stays")
    if again.limit(1).count():
        out = out.unionByName(of(again, "left_semi").dropDuplicates(key))
    return out.drop(*key)
