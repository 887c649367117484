"""Operator 8: greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one
for pieces that continue it. Where the walk cannot go on, a node's failure link says
where the rest of the word stands after the longest pieces so far are popped, and a
precomputed number how many pieces that pops. A word is read once, letter by letter,
and only numbers are added: no piece is built and no letter is read twice.

A word that no piece begins takes the bare begin mark, if the vocabulary has it, as its first piece.
A word that the vocabulary cannot cover is one unknown piece. Words are runs outside
the six ASCII white-space characters. The automaton is built once on the driver from
the vocabulary (a parameter, a few ten thousand strings) and sent to the tasks;
counting streams over whole texts without a shuffle, in slices cut at white space,
and remembers the counts of a bounded number of words.

Defined results: null or wordless text has no words and no pieces; repeated rows
count alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Collection, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import received, sent, text_or_empty, with_text_id

MEMO = 500_000
SLICE = 1 << 20
UNKNOWN = 1 << 40  # one unknown word in a packed count


class LongestMatch:
    """The automaton: transitions, failure links and popped-piece counts."""

    BEGIN, GO_ON = 0, 1

    def __init__(self, begin: Collection[str], go_on: Iterable[str]):
        self.next: dict[tuple[int, str], int] = {}
        is_piece = [False, False]
        kids: list[list[tuple[str, int]]] = [[], []]
        for root, pieces in ((self.BEGIN, begin), (self.GO_ON, go_on)):
            for p in pieces:
                at = root
                for c in p:
                    to = self.next.get((at, c))
                    if to is None:
                        to = self.next[(at, c)] = len(is_piece)
                        is_piece.append(False)
                        kids.append([])
                        kids[at].append((c, to))
                    at = to
                if p:
                    is_piece[at] = True
        self.fail = [-1] * len(is_piece)
        self.popped = [0] * len(is_piece)
        if "" in begin:  # the bare begin mark: where no piece begins the word, it is one and the word goes on
            self.fail[self.BEGIN], self.popped[self.BEGIN] = self.GO_ON, 1
        queue = deque([self.BEGIN, self.GO_ON])
        while queue:  # by depth, so shorter strings' links are known
            u = queue.popleft()
            for c, v in kids[u]:
                if is_piece[v]:
                    self.fail[v], self.popped[v] = self.GO_ON, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and (z, c) not in self.next:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[(z, c)], pops
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of the word, or -1 if the vocabulary cannot cover it."""
        step, fail, popped = self.next, self.fail, self.popped
        u, n = self.BEGIN, 0
        for c in word:
            v = step.get((u, c))
            while v is None:
                if fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
                v = step.get((u, c))
            u = v
        while u != self.GO_ON:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n


class Counts(dict):
    """Word bytes -> packed count, worked out when first asked for; bounded."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        n = self.automaton.count(word.decode("utf-8", "replace"))
        self[word] = n = n if n >= 0 else UNKNOWN + 1
        return n


def slices(data: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Slices of about ``size`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = at + size
        if end >= len(data):
            end = len(data)
        else:
            tail = data[end:end + size]
            while tail:
                head = tail.split(maxsplit=1)
                if tail[:1].isspace() or len(head) > 1 or tail[-1:].isspace():
                    end += 0 if tail[:1].isspace() else len(head[0])
                    break
                end += len(tail)
                tail = data[end:end + size]
        yield data[at:end]
        at = end


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word (without their mark; empty: the bare mark) and pieces that continue one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    begin, go_on = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            begin.append(piece[1:])
        else:
            go_on.append(piece)
    return begin, go_on


def count_pieces(docs: DataFrame, begin: list[str], go_on: list[str], id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_pieces, n_unknown)``, one row per input row."""
    automaton = sent(docs.sparkSession, LongestMatch(begin, go_on))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Counts(received(automaton))
        for pdf in batches:
            out = []
            for data in pdf["text"]:
                words = packed = 0
                for part in slices(data):
                    found = part.split()
                    words += len(found)
                    packed += sum(map(known.__getitem__, found))
                out.append((words, packed % UNKNOWN, packed // UNKNOWN))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": [o[0] for o in out],
                                "n_pieces": [o[1] for o in out], "n_unknown": [o[2] for o in out]})

    rows, kind = with_text_id(docs, id_col, text_or_empty(F.col(text_col)).cast("binary"))
    out = rows.mapInPandas(counted, "doc_id string, n_words long, n_pieces long, n_unknown long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
