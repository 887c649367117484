"""Operator 3: packing examples into sequences by vector bin packing.

Each example is a vector of demands: tokens, segments (1) and loss-bearing tokens.
Bins hold at most ``capacity`` tokens, ``max_segments`` segments and ``max_loss``
loss-bearing tokens at once. The heuristic is bin-centric: into the open bin goes,
again and again, the fitting example with the largest dot product of its demands
and the bin's remaining room, both relative to the limits, each dimension weighed by
how scarce it is among what is left to place; the bin closes when nothing fits.

Where texts may be cut, a document's full-capacity pieces fill sequences of their
own, its rest is packed, and room of ``MIN_PIECE`` tokens or more that nothing fits
into is filled by cutting the largest waiting example there.

Scale: tokenising and packing stream over the partitions of the scan, no shuffle and
no gathering; a task packs blocks of ``BLOCK`` examples, so its memory is bounded by
a block and the longest text. Sequence ids carry the partition number in their upper
bits, as Spark's own increasing ids do.

Defined results: a null text counts as empty and is the single end id; repeated rows
are packed one by one; an example over a limit by itself and not cuttable gets a
sequence of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import text_or_empty, with_text_id

CAPACITY = 1024
MAX_SEGMENTS = 64
MIN_PIECE = 16
BLOCK = 2048
PIECES = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


class Ids:
    """Token ids of whole texts by a byte-level vocabulary (ranks file and split pattern).

    ``added`` maps added tokens to their ids: as ``tokenizers`` does, they are cut out of the
    text first (the leftmost, of several there the longest) and what is between them is
    encoded stretch by stretch. Other strings that look like special tokens are
    ordinary text. A long stretch is encoded in slices: the pre-tokeniser always starts a new piece at a single space between
    two characters that are not white space, so cutting there changes no id.
    """

    SLICE = 1 << 20
    _safe = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added or {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None

    def of(self, text: str) -> np.ndarray:
        if not self._added:
            return self._stretch(text)
        stretches = self._added.split(text)  # every second one is an added token
        if len(stretches) == 1:
            return self._stretch(text)
        return np.concatenate([np.array([self.added[s]], "<u4") if i % 2 else self._stretch(s)
                               for i, s in enumerate(stretches)])

    def _stretch(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = self._safe.search(text, at + self.SLICE) if len(text) - at > 2 * self.SLICE else None
            end = cut.start() if cut else len(text)
            parts.append(self.encoding.encode_to_numpy(text[at:end], disallowed_special=()))
            at = end
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which it matches inside texts whatever ``add_special_tokens`` is."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"matching by white space or word borders is not supported: {token}")
    return {token["content"]: token["id"] for token in found}


def choose(room: np.ndarray, demands: np.ndarray, waiting: np.ndarray, limits: np.ndarray) -> int:
    """The kind of example to place next, or -1. ``demands``: one row a kind."""
    ok = (waiting > 0) & (demands <= room).all(axis=1)
    at = np.flatnonzero(ok)
    if not len(at):
        return -1
    left = (demands * waiting[:, None]).sum(axis=0) / limits
    weight = left / max(left.sum(), 1e-12)
    score = (demands[at] / limits) @ (weight * room / limits)
    return int(at[np.argmax(score)])


def pack_vectors(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of example numbers; examples over a limit alone get a bin each.

    Examples of equal demands are one kind, so a step looks at kinds, not examples.
    """
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.reshape(-1)
    queues = [list(np.flatnonzero(of == k)[::-1]) for k in range(len(kinds))]
    waiting = np.array([len(q) for q in queues])
    bins: list[list[int]] = []
    for k in np.flatnonzero((kinds > limits).any(axis=1)):
        bins += [[int(i)] for i in queues[k]]
        waiting[k] = 0
    while waiting.any():
        room, inside = limits.astype(float), []
        while (k := choose(room, kinds, waiting, limits)) >= 0:
            inside.append(int(queues[k].pop()))
            waiting[k] -= 1
            room = room - kinds[k]
        bins.append(inside)
    return bins


class Packer:
    """Packs blocks of (document, ids) rests; cuts to fill what is left open."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int):
        self.limits = np.array([capacity, max_segments, max_loss])
        self.next = 0
        self.out: list[tuple] = []

    def _place(self, inside: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in inside:
            last = start + len(ids) == total
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at,
                             len(ids) - last))
            at += len(ids)
        self.next += 1

    def pack(self, rests: list[tuple]) -> None:
        """``(doc, start, ids, total)`` each shorter than the capacity."""
        cap = int(self.limits[0])
        by: dict[tuple[int, int], list[tuple]] = {}
        for r in rests:  # kind: tokens and loss tokens; the end id bears no loss
            by.setdefault((len(r[2]), len(r[2]) - (r[1] + len(r[2]) == r[3])), []).append(r)
        kinds = sorted(by)
        demands = np.array([(t, 1, loss) for t, loss in kinds]).reshape(-1, 3)
        waiting = np.array([len(by[k]) for k in kinds], dtype=np.int64)
        left = len(rests)
        while left:
            room, inside = self.limits.astype(float), []
            while (k := choose(room, demands, waiting, self.limits)) >= 0:
                inside.append(by[kinds[k]].pop())
                waiting[k] -= 1
                left -= 1
                room = room - demands[k]
            take = int(min(room[0], room[2]))
            if left and room[1] >= 1 and take >= MIN_PIECE:
                k = int(np.flatnonzero(waiting)[-1])  # the longest kind waiting does not fit: cut it
                doc, start, ids, total = by[kinds[k]].pop()
                waiting[k] -= 1
                inside.append((doc, start, ids[:take], total))
                rest = (doc, start + take, ids[take:], total)
                kind = (len(rest[2]), len(rest[2]) - 1)
                if kind not in by:
                    by[kind] = []
                    at = int(np.searchsorted([t for t, _ in kinds], kind[0]))
                    while at < len(kinds) and kinds[at] < kind:
                        at += 1
                    kinds.insert(at, kind)
                    demands = np.insert(demands, at, (kind[0], 1, kind[1]), axis=0)
                    waiting = np.insert(waiting, at, 0)
                at = kinds.index(kind)
                by[kind].append(rest)
                waiting[at] += 1
            self._place(inside)

    def add_full(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self._place([(doc, start, ids, total)])


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY,
                   max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text",
                   added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece; see ``PIECES``. ``vocabulary``, ``pattern`` and ``added`` tokens name the tokenizer."""
    most = capacity if max_loss is None else max_loss

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Ids(vocabulary, pattern, added)
        packer = Packer(capacity, max_segments, most)
        first = TaskContext.get().partitionId() << 33
        full = min(capacity, most)
        rests: list[tuple] = []

        def flush() -> pd.DataFrame:
            rows, packer.out = packer.out, []
            doc, start, length, crc, total, seq, at, loss = zip(*rows) if rows else [()] * 8
            return pd.DataFrame({"doc_id": pd.Series(doc, dtype=object), "start": start, "length": length,
                                 "ids_crc32": crc, "doc_tokens": total,
                                 "sequence_id": np.array(seq, dtype=np.int64) + first,
                                 "offset": at, "loss_tokens": loss})

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(tokenizer.of(text), np.array([end_id], dtype="<u4"))
                total = len(ids)
                whole = total // full * full
                for start in range(0, whole, full):
                    packer.add_full(doc, start, ids[start:start + full], total)
                if whole < total:
                    rests.append((doc, whole, ids[whole:].copy(), total))
                if len(rests) >= BLOCK:
                    packer.pack(rests)
                    rests = []
                if len(packer.out) >= 8 * BLOCK:
                    yield flush()
        packer.pack(rests)
        yield flush()

    rows, kind = with_text_id(docs, id_col, text_or_empty(F.col(text_col)))
    return rows.mapInPandas(packed, PIECES).withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_examples(examples: DataFrame, limits: dict[str, int], id_col: str = "id",
                  block: int = BLOCK) -> DataFrame:
    """``(id, sequence_id)`` for examples that may not be cut.

    ``limits`` maps demand columns (tokens, segments, loss tokens, ...) to what a
    sequence holds; a null demand counts as 0.
    """
    names, most = list(limits), np.array(list(limits.values()))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, done = TaskContext.get().partitionId() << 33, 0
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at:at + block]
                bins = pack_vectors(part[names].to_numpy(dtype=np.int64), most)
                ids = part["id"].to_numpy(dtype=object)
                yield pd.DataFrame({"id": ids[[i for b in bins for i in b]],
                                    "sequence_id": [first + done + k for k, b in enumerate(bins) for _ in b]})
                done += len(bins)

    kind = examples.select(F.col(id_col)).schema[0].dataType
    rows = examples.select(F.col(id_col).cast("string").alias("id"),
                           *[F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in names])
    return rows.mapInPandas(packed, "id string, sequence_id long").withColumn("id", F.col("id").cast(kind))
