"""Operator 5: near-duplicate lines by a segment-partition edit join.

A line is a text between line ends, without ASCII white space around it; blank lines
are no lines. Two lines link when they are equal, or when both have at least
``MIN_LENGTH`` code points and their edit distance is at most ``MAX_EDITS`` (t).
With ``share`` (the registered query) the allowance follows the shorter line's length
n: 1 edit from ``LEAST_NEAR`` code points, t from ``MIN_LENGTH`` and n // share where
that is more, without an upper bound. Of each connected group of lines the first place stays (smallest doc_id, then line
number), all others are dropped.

1. Equal lines meet in a partial aggregate: everything below sees distinct lines.
2. A line of length l is split into t + 1 segments; of a line within t edits at least
   one is a substring. A line probes, for the lengths l - t to l, the substrings that
   the multi-match-aware windows leave (12 for t = 2); its own segments are among
   them, marked as index. A key is length, segment number and content. From the length
   on at which n // share exceeds t, a line has keys of another kind, whose number does not grow
   with the square of the allowance: its grams of ``GRAM`` code points with the smallest hashes, as many as it
   takes until t + 1 of them are disjoint. An edit changes one of these at most, so of two
   lines within t edits the one whose hashes end first has a gram that is unchanged in the
   other, among its keys too and shifted by the allowance at most.
3. Most keys have one line and are dropped where they meet; on the way there the keys of
   many lines travel together, in arrays by bucket of the key. A key that alone has over ``HOT_ROWS`` rows
   in an array is kept as it is and leaves one row behind to tell the others. Of keys with the
   same lines, as far apart in all, one stays.
4. All lines of the keys that have the same smallest index line meet in one task (of a
   group of over ``SPLIT_ROWS`` rows each is compared in one of several). Pairs must agree in length, in
   the parity sketch of their letters (an edit flips at most two of its 64 bits) and in the letters' counts;
   lines without such a pair leave before the texts come.
5. What is left is verified by edit distance on the texts, after counts of pairs of letters, the
   most alike first: the furthest points of the diagonals, of many pairs of lines at once. Pairs that others
   have joined by then are left out, and a task gives each line it joined beside the smallest of its
   component, so links are no more than a group's rows. Only the
   lines that still have keys move, told from the others by a bitmap of fixed size (2 MB).

Defined results: null and blank texts have no lines; lines shorter than
``MIN_LENGTH`` (with ``share``: ``LEAST_NEAR``, of which an edit is half or
more) are compared for equality only; repeated rows are later places of the
same lines; a null doc_id comes after all others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ASCII_SPACE, durable, release, text_or_empty, with_text_id
from .components import connected_components

MAX_EDITS = 2
MIN_LENGTH = 24
SHARE = 40
LEAST_NEAR = 3
GRAM = 16
BAND_EDITS = 4
CHUNK_LETTERS = 1 << 21
RATES = (28, 22, 18, 15, 12, 9, 6)  # one gram in so many is tried as a line's keys
DENSE_RATES = (3, 1)
FLUSH_ROWS = 200_000
FLUSH_KEYS = 1_000_000
BUCKET_LETTERS = 10_000_000  # of all lines, to one bucket of keys
HOT_ROWS = 2_000
MEMO = 300_000
WANTED_BITS = 24  # 2 MB


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """``(line number, line)`` of the lines that are not blank."""
    for i, line in enumerate(text.split("\n")):
        line = line.strip(ASCII_SPACE)
        if line:
            yield i, line


def line_hash(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h[8:], signed=True), int.from_bytes(h[:8], signed=True)


def line_hashes(lines: list[str]) -> np.ndarray:
    """``line_hash`` of each, as rows of two."""
    found = b"".join([xxhash.xxh3_128_digest(l.encode("utf-8", "surrogatepass")) for l in lines])
    return np.frombuffer(found, dtype=">i8").astype(np.int64).reshape(-1, 2)[:, ::-1]


def segments(n: int, t: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the t + 1 even segments of a string of n; the last are longer."""
    short, longer = n // (t + 1), n % (t + 1)
    out, at = [], 0
    for i in range(t + 1):
        size = short + (i >= t + 1 - longer)
        out.append((at, size))
        at += size
    return out


def probes(n: int, t: int) -> list[tuple[int, int, int, int, bool]]:
    """``(indexed length, segment, start, size, own)`` a line of length n looks up."""
    return [p for length in range(max(t + 1, n - t), n + 1) for p in probes_at(n, length, t)]


def probes_at(n: int, length: int, t: int) -> list[tuple[int, int, int, int, bool]]:
    """Those for one indexed length, whose lines are split for t edits."""
    out, delta = [], n - length
    for i, (p, size) in enumerate(segments(length, t), start=1):
        lo = max(p - (i - 1), p + delta - (t + 1 - i), 0)
        hi = min(p + (i - 1), p + delta + (t + 1 - i), n - size)
        out += [(length, i, at, size, delta == 0 and at == p) for at in range(lo, hi + 1)]
    return out


@dataclass(frozen=True)
class Allowance:
    """The edits within which two lines link, by the length of the shorter one."""

    t: int
    least: int
    share: int | None = None

    def __post_init__(self):
        if self.share and self.window < 1:
            raise ValueError(f"a share of 1 in {self.share} leaves no common run of {GRAM} code points")

    @property
    def shortest(self) -> int:
        return min(LEAST_NEAR, self.least) if self.share else self.least

    @property
    def long(self) -> int:
        """The length from which lines have grams, not segments, as keys."""
        return max(self.least, self.share * (self.t + 1)) if self.share else 1 << 31

    @property
    def window(self) -> int:
        """Neighbouring grams inside the run that long lines within the allowance share.

        At least one, so that a long line has more disjoint grams than its allowance.
        """
        return -(-(self.share - 1) * (self.t + 1) // (self.t + 2)) - GRAM + 1

    def edits(self, n: int) -> int:
        if n < self.least:
            return 1 if n >= self.shortest else 0
        return max(self.t, n // self.share) if self.share else self.t

    def of(self, n: np.ndarray) -> np.ndarray:
        """``edits`` of each length, 1 below the shortest."""
        most = np.maximum(self.t, n // self.share) if self.share else np.full(len(n), self.t)
        return np.where(n < self.least, 1, most)

    def probes(self, n: int) -> list[tuple[int, int, int, int, bool]]:
        most = max(1, self.t)
        out = []
        for length in range(max(self.shortest, n - most), min(n + 1, self.long)):
            t = self.edits(length)
            if n - length <= t < length:
                out += probes_at(n, length, t)
        return out


def letters(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(c: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` (a power of two) code points from each place on."""
    block = 1 << 15  # stays in the processor's cache
    if len(c) > block + size:
        return np.concatenate([grams(c[at:at + block + size - 1], size) for at in range(0, len(c) - size + 1, block)])
    h = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = 1
    while step < size:
        more = h[step:]
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step)
        h += more
        step *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def substring_keys(lines: list[str], places: list[tuple[int, int, int, int, bool]]) -> np.ndarray:
    """Of each of the lines (all of one length) the keys of the ``probes``: length, segment number and content."""
    length, segment, at, size = (np.array(x, dtype=np.int64) for x in list(zip(*places))[:4])
    n, base = len(lines[0]), 0x9E3779B97F4A7C15
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    back = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    back[0] = 1
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    c = (letters("".join(lines)).reshape(-1, n).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(29)
    c *= powers
    sums = np.zeros((len(lines), n + 1), dtype=np.uint64)
    np.cumsum(c, axis=1, out=sums[:, 1:])
    h = (sums[:, at + size] - sums[:, at]) * back[at]
    h += (length * 16 + segment).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def have_disjoint(at: np.ndarray, of: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which lines have ``need`` disjoint grams among those at the given (ascending) places."""
    after = np.append(np.searchsorted(at, at + GRAM), len(at))
    cut = np.searchsorted(of, np.arange(len(need) + 1))
    now, end, lacking = cut[:-1].copy(), cut[1:], need.copy()
    going = np.flatnonzero(end - now >= need)
    while len(going):
        lacking[going] -= 1
        now[going] = after[now[going]]
        going = going[(lacking[going] > 0) & (now[going] < end[going])]
    return lacking <= 0


def smallest_grams(lines: list[str], edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(line number, key, place)``: the grams of the smallest hashes, among them ``edits + 1`` disjoint ones.

    Every line has at least ``GRAM * (edits + 1)`` code points. All grams of a line up
    to some hash are taken.
    """
    sizes = np.array([len(l) for l in lines])
    ends, need = np.cumsum(sizes), edits + 1
    starts = ends - sizes
    h = grams(letters("".join(lines)), GRAM)
    left = np.ones(len(lines), dtype=bool)
    found = []
    for rates in (RATES, DENSE_RATES):
        if rates is RATES:
            at = np.flatnonzero(h <= np.uint64((1 << 64) // rates[-1]))
        elif left.any():
            at = np.concatenate([np.arange(i, j - GRAM + 1) for i, j in zip(starts[left], ends[left])])
        else:
            break
        of = np.repeat(np.arange(len(lines)), np.diff(np.searchsorted(at, ends), prepend=0))
        inside = at + GRAM <= ends[of]
        at, of = at[inside], of[inside]
        key = h[at]
        for rate in rates:
            some = key <= np.uint64(((1 << 64) - 1) // rate)
            enough = have_disjoint(at[some], of[some], need)
            take = some & enough[of]
            found.append((of[take], key[take], at[take]))
            left &= ~enough
            stay = ~enough[of]
            at, of, key = at[stay], of[stay], key[stay]
    of, key, at = (np.concatenate(x) for x in zip(*found))
    return of, (key * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), (at - starts[of]).astype(np.int32)


def parity(line: str) -> int:
    """64 bits: the parity of the letters hashed to each. An edit flips two at most."""
    c = letters(line)
    at = (c * np.uint32(0x9E3779B1)) >> np.uint32(26)
    odd = (np.bincount(at, minlength=64) & 1).astype(np.uint8)
    return int(np.packbits(odd, bitorder="little").view("<i8")[0])


def parities(lines: list[str]) -> np.ndarray:
    """``parity`` of each line; none is empty."""
    if not lines:
        return np.zeros(0, dtype=np.int64)
    sizes = np.array([len(l) for l in lines])
    at = letters("".join(lines)) * np.uint32(0x9E3779B1)
    at >>= np.uint32(26)
    bits = (np.uint64(1) << np.arange(64, dtype=np.uint64))[at]
    return np.bitwise_xor.reduceat(bits, np.cumsum(sizes) - sizes).view(np.int64)


COUNTS = ["counts_0", "counts_1", "counts_2", "counts_3"]


def letter_counts(lines: list[str]) -> np.ndarray:
    """Four times 64 bits of each line: how often the letters of each of 32 kinds occur, modulo 16.

    A count is written in eight bits of which the next count changes one, so an edit
    flips two at most. Letters' parities tell long lines of one language badly apart.
    """
    sizes = np.array([len(l) for l in lines], dtype=np.int64)
    kind = (letters("".join(lines)) & np.uint32(31)).astype(np.int64)
    kind += np.repeat(np.arange(len(lines)) << 5, sizes)
    found = np.bincount(kind, minlength=len(lines) << 5) & 15
    code = np.array([(1 << i) - 1 if i <= 8 else 255 & ~((1 << (i - 8)) - 1) for i in range(16)], dtype=np.uint8)
    return code[found].view("<i8").reshape(-1, 4)


def within(a: str, b: str, t: int) -> bool:
    """Edit distance at most t, by the bit-parallel recurrence in a band of 2t + 1 diagonals.

    Equal ends are stripped first. A set bit j of row e says that diagonal j - t is
    reachable to the current depth with e edits.
    """
    if abs(len(a) - len(b)) > t:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the common prefix, by halves
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[:len(a) - lo], b[:len(b) - lo]
    if not a or not b:
        return max(len(a), len(b)) <= t
    width = 2 * t + 1
    full = (1 << width) - 1
    # bit j of rows[e]: a's first i letters turn into b's first i + j - t with at most e edits
    rows = [((1 << (t + e + 1)) - 1) & ~((1 << t) - 1) & full for e in range(t + 1)]
    for i, c in enumerate(a, start=1):
        same = valid = 0
        for j in range(width):
            at = i + j - t
            if 0 <= at <= len(b):
                valid |= 1 << j
                if at and b[at - 1] == c:
                    same |= 1 << j
        old, below = rows, 0
        rows = []
        for e in range(t + 1):
            new = old[e] & same
            if e:
                # substitution keeps the diagonal, deletion comes from the next, insertion from the one below
                new |= old[e - 1] | (old[e - 1] >> 1) | (below << 1)
            new &= valid & full
            below = new
            rows.append(new)
        if not any(rows):
            return False
    j = len(b) - len(a) + t
    return any(r >> j & 1 for r in rows)


def grams_allow(a: str, b: str, t: int, size: int = 4) -> bool:
    """The counts of hashed grams allow t edits: an edit replaces ``size`` of them at most."""
    shift = np.uint64(64 - min(20, max(10, len(a).bit_length() + 1)))
    x, y = ((grams(letters(s), size) >> shift).astype(np.int64) for s in (a, b))
    most = 1 << (64 - int(shift))
    return int(np.abs(np.bincount(x, minlength=most) - np.bincount(y, minlength=most)).sum()) <= 2 * size * t


def common_run(a: str, i: int, b: str, j: int) -> int:
    """How many code points are equal from ``a[i]`` and ``b[j]`` on."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 8
    if most > 0 and a[i] != b[j]:
        return 0
    while n < most and a[i + n:i + n + step] == b[j + n:j + n + step]:
        n += step
        step *= 2
    if n >= most:
        return most
    hi = min(most, n + step)
    while n < hi:  # equal up to n, not up to hi + 1
        mid = (n + hi + 1) // 2
        if a[i + n:i + mid] == b[j + n:j + mid]:
            n = mid
        else:
            hi = mid - 1
    return n


def within_far(a: str, b: str, t: int) -> bool:
    """Edit distance at most t by the furthest points of the diagonals: work grows with the distance squared."""
    end = len(b) - len(a)
    if abs(end) > t or min(len(a), len(b)) >= 8 and not grams_allow(a, b, t):
        return False
    reach = {0: common_run(a, 0, b, 0)}  # diagonal j - i: the furthest i
    for e in range(t + 1):
        if e:
            old, reach = reach, {}
            for k in range(max(-e, end - (t - e)), min(e, end + (t - e)) + 1):
                i = max(old.get(k - 1, -1), old.get(k, -2) + 1, old.get(k + 1, -2) + 1)
                i = min(i, len(a), len(b) - k)
                if i >= 0 and i + k >= 0:
                    reach[k] = i + common_run(a, i, b, i + k)
        if reach.get(end, -1) >= len(a):
            return True
    return False


def linked(a: str, b: str, allowed: Allowance) -> bool:
    t = allowed.edits(min(len(a), len(b)))
    return within(a, b, t) if t <= BAND_EDITS else within_far(a, b, t)


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    row = TaskContext.get().partitionId() << 33

    def frame(docs: list, first: int, counts: list[int], at: list[int], lines: list[str]) -> pd.DataFrame:
        of = np.repeat(np.arange(len(docs)), counts)
        h = line_hashes(lines)
        return pd.DataFrame({"doc_id": np.array(docs, dtype=object)[of], "row": first + of, "at": at, "line": h[:, 0],
                             "check": h[:, 1], "n": [len(l) for l in lines]})

    for pdf in batches:
        docs, counts, at, lines, waiting = [], [], [], [], 0
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            docs.append(doc)
            at.append(-1)  # the row itself
            lines.append(" ")
            before = len(at) - 1
            for i, line in lines_of(text):
                at.append(i)
                lines.append(line)
            counts.append(len(at) - before)
            waiting += len(text)
            if len(at) > FLUSH_ROWS or waiting > CHUNK_LETTERS:
                yield frame(docs, row, counts, at, lines)
                row += len(docs)
                docs, counts, at, lines, waiting = [], [], [], [], 0
        if docs:
            yield frame(docs, row, counts, at, lines)
            row += len(docs)


def _new_lines(pdf: pd.DataFrame, seen: set[int], least: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, str]]:
    """The lines not seen before, and of these only those whose hash has its bit in ``wanted``."""
    lines: list[str] = []
    waiting = 0

    def new() -> Iterator[tuple[int, str]]:
        h = line_hashes(lines)[:, 0]
        some = np.arange(len(h))
        if wanted is not None:
            some = np.flatnonzero(wanted[(h & ((len(wanted) << 6) - 1)) >> 6] >> (h & 63) & 1)
        for k, x in zip(some.tolist(), h[some].tolist()):
            if x not in seen:
                if len(seen) > MEMO:
                    seen.clear()
                seen.add(x)
                yield x, lines[k]

    for text in pdf["text"]:
        lines += [line for _, line in lines_of(text) if len(line) >= least]
        waiting += len(text)
        if waiting > CHUNK_LETTERS:
            yield from new()
            lines, waiting = [], 0
    if lines:
        yield from new()


KEY_ROWS = "key long, line long, first int, last int, own boolean"
PACKED_ROWS = "bucket int, hot boolean, own boolean, keys binary, lines binary, places binary"  # places: with the line's length
MOST_PLACE = (1 << 16) - 1


def _gram_keys(lines: list[tuple[int, str]], allowed: Allowance, sketched: bool = True) -> pd.DataFrame:
    """``(key, line, place, n)`` of long lines, and the ``sketch`` of each if wanted."""
    hashes = np.array([h for h, _ in lines], dtype=np.int64)
    texts = [l for _, l in lines]
    of, key, place = smallest_grams(texts, np.array([allowed.edits(len(l)) for l in texts]))
    sizes = np.array([len(l) for l in texts])
    out = pd.DataFrame({"key": key, "line": hashes[of], "place": place, "n": sizes[of]})
    return out.assign(sketch=parities(texts)[of]) if sketched else out


def key_order(key: np.ndarray, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows in order of key, and in order of line and place where a key has several."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    rows = order[several]
    order[several] = rows[np.lexsort((place[rows], line[rows], key[rows]))]
    return order


def _packed(key: np.ndarray, line: np.ndarray, place: np.ndarray, n: np.ndarray, own: bool, buckets: int) -> Iterator[pd.DataFrame]:
    """One row per bucket, of each key and line the first and the last place; hot keys beside them.

    Places and lengths end at ``MOST_PLACE``, which brings none further apart.
    """
    order = key_order(key, line, place)
    key, line = key[order], line[order]
    place = np.minimum(np.stack([place[order], n[order]], axis=1), MOST_PLACE).astype(np.uint16)
    same = (key[1:] == key[:-1]) & (line[1:] == line[:-1])
    ends = ~(np.append(False, same) & np.append(same, False))
    key, line, place = key[ends], line[ends], place[ends]

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(start, append=len(key))
    hot = np.repeat(count > HOT_ROWS, count)
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    low = key.astype(np.uint32)

    def rows(which: np.ndarray, to: np.ndarray, keys: np.ndarray, is_hot: bool) -> pd.DataFrame:
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
        parts = [slice(i, j) for i, j in zip(cut, [*cut[1:], len(to)])]
        lines, places = line[which], place[which]
        return pd.DataFrame({"bucket": to[cut], "hot": is_hot, "own": own,
                             "keys": [keys[p].tobytes() for p in parts], "lines": [lines[p].tobytes() for p in parts],
                             "places": [places[p].tobytes() for p in parts]})
    stays = ~hot
    stays[start] = True
    yield rows(stays, bucket[stays], low[stays], False)
    if hot.any():
        at = np.flatnonzero(hot)
        full = (bucket[at].astype(np.int64) << 32) | low[at]
        for i in range(0, len(at), FLUSH_ROWS):
            part = at[i:i + FLUSH_ROWS]
            to = np.full(len(part), xxhash.xxh3_64_intdigest(line[part[:1]].tobytes()) % buckets, dtype=np.int32)
            yield rows(part, to, full[i:i + FLUSH_ROWS], True)


def _shared(allowed: Allowance, group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """``KEY_ROWS`` of the keys of one bucket that several lines have which may be near, one of them by its own place."""
    bucket, hot = group
    key = np.concatenate([np.frombuffer(x, dtype=np.int64 if hot else np.uint32) for x in pdf["keys"]]).astype(np.int64)
    line = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["lines"]])
    place, n = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in pdf["places"]]).reshape(-1, 2).T.astype(np.int32)
    own = np.repeat(pdf["own"].to_numpy(dtype=bool), [len(x) // 8 for x in pdf["lines"]])
    order = key_order(key, line, place)
    if not hot:
        same = key[order][1:] == key[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]
    key, line, place, n, own = key[order], line[order], place[order], n[order], own[order]
    start = np.flatnonzero(changes(key, line))
    last = place[np.append(start[1:], len(key))[:len(start)] - 1]
    key, line, first, n, own = key[start], line[start], place[start], n[start], np.logical_or.reduceat(own, start) if len(start) else own
    if not hot:
        good = _beside_others(allowed, key, n, first, last, own)
        key, line, first, last, own = key[good] | np.int64(bucket) << 32, line[good], first[good], last[good], own[good]
    return pd.DataFrame({"key": key, "line": line, "first": first, "last": last, "own": own})


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.append(True, new) if len(columns[0]) else new


def _beside_others(allowed: Allowance, key, n, first, last, own) -> np.ndarray:
    """The rows left when each key's lines fall apart where no lengths, then no places are within the allowance.

    Of a group there must be two, one with its own place.
    """
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    t = allowed.of(n)
    t[n == MOST_PLACE] = 1 << 20  # longer by no one knows how much
    order = np.lexsort((n, key))
    gap = np.append(False, (n[order][1:] - n[order][:-1]) > t[order][:-1])
    run = np.cumsum(changes(key[order]) | gap)
    most = np.maximum.reduceat(t[order], np.flatnonzero(changes(run)))[run - 1]
    inner = np.lexsort((first[order], run))
    order, run, most = order[inner], run[inner], most[inner]
    reached = np.maximum.accumulate((run.astype(np.int64) << 32) + last[order]) - (run.astype(np.int64) << 32)
    gap = np.append(False, first[order][1:] - reached[:-1] > most[1:])
    start = np.flatnonzero(changes(run) | gap)
    count = np.diff(start, append=len(run))
    good = np.repeat((count > 1) & np.logical_or.reduceat(own[order], start), count)
    return order[good]


def _keyed(allowed: Allowance, buckets: int):
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        waiting = {"short": 0, "long": 0}
        short: dict[int, list[tuple[int, str]]] = {}
        long: list[tuple[int, str]] = []
        found: dict[bool, list] = {True: [], False: []}  # key, line, place and length, by whether it is the line's own

        def short_keys() -> None:
            for n, lines in short.items():
                places = allowed.probes(n)
                if not places:
                    continue
                keys = substring_keys([l for _, l in lines], places)
                hashes = np.array([h for h, _ in lines], dtype=np.int64)
                owns = np.array([p[4] for p in places])
                for own in (True, False):
                    k = keys[:, owns == own]
                    found[own].append((k.ravel(), np.repeat(hashes, k.shape[1]), np.zeros(k.size, dtype=np.int32),
                                       np.full(k.size, n)))
            short.clear()
            waiting["short"] = 0

        def long_keys() -> None:
            if long:
                f = _gram_keys(long, allowed, sketched=False)
                found[True].append((f["key"].to_numpy().view(np.uint64), f["line"].to_numpy(), f["place"].to_numpy(),
                                    f["n"].to_numpy()))
            long.clear()
            waiting["long"] = 0

        def flushed(most: int) -> Iterator[pd.DataFrame]:
            for own, parts in found.items():
                if sum(len(part[0]) for part in parts) > most:
                    yield from _packed(*(np.concatenate(x) for x in zip(*parts)), own, buckets)
                    parts.clear()

        least_long, most_short = allowed.long, allowed.long + allowed.t
        for pdf in batches:
            for h, line in _new_lines(pdf, seen, allowed.shortest):
                n = len(line)
                if n >= least_long:
                    long.append((h, line))
                    waiting["long"] += n
                if n <= most_short:  # a shorter kind of line may be near
                    short.setdefault(n, []).append((h, line))
                    waiting["short"] += n
                if waiting["short"] > CHUNK_LETTERS or waiting["long"] > CHUNK_LETTERS:
                    short_keys() if waiting["short"] > CHUNK_LETTERS else long_keys()
                    yield from flushed(FLUSH_KEYS)
        short_keys()
        long_keys()
        yield from flushed(0)
    return keyed


TEXT_ROWS = "line long, words string, n int, sketch long, " + ", ".join(f"{c} long" for c in COUNTS)


def _texts(least: int, bits: np.ndarray):
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            found = list(_new_lines(pdf, seen, least, bits))
            lines = [l for _, l in found]
            if lines:
                yield pd.DataFrame({"line": [h for h, _ in found], "words": lines, "n": [len(l) for l in lines],
                                    "sketch": parities(lines), **dict(zip(COUNTS, letter_counts(lines).T))})
    return texts


def hash_bits(lines: DataFrame, size: int = WANTED_BITS) -> np.ndarray:
    """A bit for each hash of ``line`` modulo 2**size: of fixed size, whatever the input.

    Tells tasks which lines surely are not wanted; an exact join follows.
    """
    at = lines.select(F.col("line").bitwiseAND(F.lit((1 << size) - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (size - 6), dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out


GROUP_ROWS = "lead long, part int, line long, probe boolean"
SPLIT_ROWS = 4_000  # a larger group's rows are each compared in one of several tasks
TOGETHER_ROWS = 20_000
RAW_PAIRS = 1 << 19
MOST_PAIRS = 1 << 20
BIGRAMS = 512  # 9 bits of a hash
BIGRAM_ROWS = 4_096
REACH_CELLS = 1 << 19
STRIDE = 32
NOWHERE = -(1 << 30)


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows again, as frames that end where a group ends, each about ``TOGETHER_ROWS`` or some chunks' letters."""
    waiting: list[pd.DataFrame] = []
    rows = letters_ = 0
    for pdf in batches:
        waiting.append(pdf)
        rows, letters_ = rows + len(pdf), letters_ + int(pdf["n"].sum())
        if rows > TOGETHER_ROWS or letters_ > 4 * CHUNK_LETTERS:
            pdf = pd.concat(waiting, ignore_index=True)
            new = np.flatnonzero(changes(pdf["lead"].to_numpy(), pdf["part"].to_numpy()))
            if new[-1]:
                yield pdf[:new[-1]]
            waiting = [pdf[new[-1]:]]
            rows, letters_ = len(waiting[0]), int(waiting[0]["n"].sum())
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def in_groups(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows by group and length, and the number of each one's group."""
    group = np.cumsum(changes(pdf["lead"].to_numpy(), pdf["part"].to_numpy()))
    order = np.lexsort((pdf["line"].to_numpy(), pdf["n"].to_numpy(), group))
    return pdf.iloc[order], group[order]


class Joined:
    """The components that links make of rows."""

    def __init__(self, rows: int):
        self.label = np.arange(rows)

    def of(self, i: int) -> int:
        while self.label[i] != i:
            i = self.label[i]
        return i

    def join(self, pairs: Iterator[tuple[int, int]], check=None) -> None:
        """Link the pairs that are still apart, and that ``check`` finds linked."""
        for i, j in pairs:
            x, y = self.of(i), self.of(j)
            if x != y and (check is None or check(i, j)):
                self.label[max(x, y)] = min(x, y)
        while (self.label[self.label] != self.label).any():
            self.label = self.label[self.label]


def near_pairs(pdf: pd.DataFrame, group: np.ndarray, t: np.ndarray, joined: Joined) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)`` of rows of one group whose lengths, sketches and counts of letters allow the edits.

    Rows are by group and length, so the allowance ``t`` is that of i. Each pair comes where i is a
    ``probe``, pairs that are ``joined`` by then do not come.
    """
    n = pdf["n"].to_numpy().astype(np.int64)
    codes = [pdf[c].to_numpy().view(np.uint64) for c in ("sketch", *COUNTS)]
    at = (group.astype(np.int64) << 32) + n
    rows = np.arange(len(n))
    count = np.where(pdf["probe"].to_numpy(dtype=bool), np.searchsorted(at, at + t, side="right") - rows - 1, 0)
    before = np.cumsum(count) - count
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + RAW_PAIRS)))
        some = count[lo:hi]
        i = np.repeat(rows[lo:hi], some)
        j = np.arange(len(i)) - np.repeat(before[lo:hi] - before[lo], some) + i + 1
        lo = hi
        apart = joined.label[i] != joined.label[j]
        i, j = i[apart], j[apart]
        alike = np.bitwise_count(codes[0][i] ^ codes[0][j]) <= 2 * t[i]
        i, j = i[alike], j[alike]
        far = sum(np.bitwise_count(c[i] ^ c[j]).astype(np.int32) for c in codes[1:])
        alike = far <= 2 * t[i]
        yield i[alike], j[alike]


def _with_others(allowed: Allowance):
    """The rows of a group that have a near pair in it."""
    def with_others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            pdf, group = in_groups(pdf)
            found = np.zeros(len(pdf), dtype=bool)
            for i, j in near_pairs(pdf, group, allowed.of(pdf["n"].to_numpy()), Joined(len(pdf))):
                found[i] = found[j] = True
            yield pdf.loc[found, ["lead", "part", "line", "probe"]]
    return with_others


def bigram_counts(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often hashed pairs of neighbouring letters occur in each string, up to 255. An edit changes four counts by one at most."""
    out = np.empty((len(size), BIGRAMS), dtype=np.uint8)
    for k in range(0, len(size), BIGRAM_ROWS):
        first, pairs = start[k:k + BIGRAM_ROWS], np.maximum(size[k:k + BIGRAM_ROWS] - 1, 0)
        of = np.repeat(np.arange(len(pairs)), pairs)
        at = np.arange(len(of)) + np.repeat(first - (np.cumsum(pairs) - pairs), pairs)
        kind = (codes[at].astype(np.uint32) * np.uint32(0x9E3779B1) + codes[at + 1]) * np.uint32(0x85EBCA6B) >> np.uint32(23)
        found = np.bincount(of * BIGRAMS + kind, minlength=len(pairs) * BIGRAMS)
        out[k:k + BIGRAM_ROWS] = np.minimum(found, 255).reshape(-1, BIGRAMS)
    return out


def coded(lines: list[str]) -> tuple[np.ndarray, bool]:
    """The letters of the lines, one after the other, as bytes, with ``STRIDE`` more; whether different letters have different bytes."""
    c = letters("".join(lines))
    known = np.zeros(0x110000, dtype=bool)
    known[c] = True
    known = np.flatnonzero(known)
    table = np.zeros(0x110000, dtype=np.uint8)
    table[known] = np.arange(len(known)) % 256
    return np.append(table[c], np.zeros(STRIDE, dtype=np.uint8)), len(known) <= 256


def equal_runs(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from the places a and b on."""
    out = np.zeros(len(a), dtype=np.int32)
    going = np.flatnonzero((codes[a] == codes[b]) & (most > 0))
    windows = np.lib.stride_tricks.sliding_window_view(codes, STRIDE)
    while len(going):
        other = windows[a[going] + out[going]] != windows[b[going] + out[going]]
        run = np.where(other.any(axis=1), other.argmax(axis=1), STRIDE)
        out[going] += run.astype(np.int32)
        going = going[(run == STRIDE) & (out[going] < most[going])]
    return np.minimum(out, most)


def within_each(codes: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``within_far`` of many pairs of strings of bytes, all pairs going on together."""
    out = np.zeros(len(i), dtype=bool)
    order = np.argsort(t, kind="stable")
    while len(order):
        fit = int(np.searchsorted(np.arange(1, len(order) + 1) * (2 * t[order].astype(np.int64) + 3), REACH_CELLS, side="right"))
        some, order = order[:max(1, fit)], order[max(1, fit):]
        out[some] = _within_some(codes, start[i[some]], size[i[some]], start[j[some]], size[j[some]], t[some])
    return out


def _within_some(codes: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), dtype=bool)
    live = np.flatnonzero(np.abs(nb - na) <= t)
    if not len(live):
        return out
    a, na, b, nb, t = (x[live].astype(np.int64) for x in (a, na, b, nb, t))
    most = int(t.max())
    reach = np.full((len(live), 2 * most + 3), NOWHERE, dtype=np.int32)  # of diagonal k = j - i, at k + most + 1, the furthest i
    for e in range(most + 1):
        end = nb - na
        lo, hi = max(-e, int((end - t).min()) + e), min(e, int((end + t).max()) - e)
        k = np.arange(lo, hi + 1)
        at = slice(lo + most + 1, hi + most + 2)
        if e:
            new = np.maximum(reach[:, at], reach[:, lo + most + 2:hi + most + 3])
            new += 1
            np.maximum(new, reach[:, lo + most:hi + most + 1], out=new)
            new = np.minimum(new, np.minimum(na[:, None], nb[:, None] - k))
        else:
            new = np.zeros((len(live), 1), dtype=np.int32)
        row, col = np.nonzero((new >= np.maximum(0, -k)) & (np.abs(end[:, None] - k) <= (t - e)[:, None]))
        x = new[row, col].astype(np.int64)
        y = x + k[col]
        x += equal_runs(codes, a[row] + x, b[row] + y, np.minimum(na[row] - x, nb[row] - y))
        reach[:] = NOWHERE
        reach[row, col + lo + most + 1] = x
        done = reach[np.arange(len(live)), end + most + 1] >= na
        out[live[done]] = True
        stay = ~done & (t > e)
        if not stay.all():
            live, a, na, b, nb, t, reach = live[stay], a[stay], na[stay], b[stay], nb[stay], t[stay], reach[stay]
            if not len(live):
                break
    return out


def join_near(joined: Joined, lines: list[str], i: np.ndarray, j: np.ndarray, t: np.ndarray, allowed: Allowance) -> None:
    """Verify pairs of rows until every one is joined or found to be no link, the most alike first."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[:len(i)], at[len(i):]
    texts = [lines[r] for r in rows]
    size = np.array([len(l) for l in texts])
    start = np.cumsum(size) - size
    codes, exact = coded(texts)
    counts = bigram_counts(codes, start, size)
    far = np.empty(len(i), dtype=np.int32)
    for k in range(0, len(i), 1 << 13):
        x, y = counts[i[k:k + (1 << 13)]], counts[j[k:k + (1 << 13)]]
        far[k:k + (1 << 13)] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int32)
    order = np.argsort(far / t, kind="stable")
    order = order[far[order] <= 4 * t[order]]
    i, j, t = i[order], j[order], t[order]
    turn = 0
    while len(i):
        if turn < 3:  # the best pair of each row
            some = np.zeros(len(i), dtype=bool)
            some[np.unique(i, return_index=True)[1]] = some[np.unique(j, return_index=True)[1]] = True
        else:
            some = np.arange(len(i)) < 1 << (9 + turn)
        turn += 1
        good = np.flatnonzero(some)
        good = good[within_each(codes, start, size, i[good], j[good], t[good])]
        joined.join(zip(rows[i[good]].tolist(), rows[j[good]].tolist()),
                    None if exact else lambda x, y: linked(lines[x], lines[y], allowed))
        stay = ~some & (joined.label[rows[i]] != joined.label[rows[j]])
        i, j, t = i[stay], j[stay], t[stay]


def _links(allowed: Allowance):
    """``(a, b)``: the lines ``b`` that links join in a group, each beside the smallest line ``a`` of its component."""
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            pdf, group = in_groups(pdf)
            lines, line = pdf["words"].tolist(), pdf["line"].to_numpy()
            t = allowed.of(pdf["n"].to_numpy())
            joined = Joined(len(pdf))
            waiting, found = 0, []

            def verify() -> None:
                if found:
                    i, j = (np.concatenate(x) for x in zip(*found))
                    apart = joined.label[i] != joined.label[j]
                    if apart.any():
                        join_near(joined, lines, i[apart], j[apart], t[i[apart]], allowed)
                    found.clear()

            pairs = near_pairs(pdf, group, t, joined)
            for i, j in pairs:
                found.append((i, j))
                waiting += len(i)
                if waiting > MOST_PAIRS:
                    verify()
                    waiting = 0
            verify()
            label = joined.label
            least = np.full(len(line), np.iinfo(np.int64).max)
            np.minimum.at(least, label, line)
            b = np.flatnonzero(least[label] < line)
            yield pd.DataFrame({"a": least[label[b]], "b": line[b]})
    return links


def without_repeated_groups(rows: DataFrame) -> DataFrame:
    """``KEY_ROWS`` without the keys that bring together the same lines, as far apart, as another key does.

    Lines that share a passage share all its keys; one of these names every pair. Beside them
    is the key's ``lead``, the smallest of the lines that have it as their own.
    """
    rows = rows.repartition("key").groupBy("key", "line").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.max("own").alias("own"))
    of_key = Window.partitionBy("key")
    rows = rows.select("*", F.min(F.struct("line", "first")).over(of_key).alias("least"),
                       F.min(F.when(F.col("own"), F.col("line"))).over(of_key).alias("lead"))
    apart = ["line", F.col("first") - F.col("least.first"), F.col("last") - F.col("least.first"), "own"]
    is_least = F.col("line") == F.col("least.line")  # one row of a key has what its lines are told by
    rows = rows.select("key", "line", "first", "last", "own", "lead", F.count("*").over(of_key).alias("lines"),
                       *(F.when(is_least, F.bit_xor(F.xxhash64(F.lit(k), *apart)).over(of_key)).alias(f"sign_{k}") for k in (1, 2)))
    rows = durable(rows.where("lines > 1 and lead is not null"))
    kept = rows.where("sign_1 is not null").groupBy("lines", "sign_1", "sign_2").agg(F.min("key").alias("key")).select("key")
    return rows.select("key", "line", "first", "last", "own", "lead").join(kept, "key", "left_semi")


def line_links(docs: DataFrame, size: int, t: int = MAX_EDITS, least: int = MIN_LENGTH,
               share: int | None = None) -> DataFrame:
    """``(a, b)``: links of distinct lines that connect every linked pair.

    ``docs``: doc_id, text. ``size``: about how many letters their lines have; keys are dealt to buckets by it.
    """
    spark = docs.sparkSession
    allowed = Allowance(t, least, share)
    buckets = 64 + size // BUCKET_LETTERS
    packed = docs.select("text").mapInPandas(_keyed(allowed, buckets), PACKED_ROWS)
    rows = durable(packed.groupBy("bucket", "hot").applyInPandas(
        lambda group, pdf: _shared(allowed, group, pdf), KEY_ROWS))
    rows = durable(without_repeated_groups(rows))
    release(spark)
    held = durable(rows.select("line").distinct())
    texts = docs.select("text").mapInPandas(_texts(allowed.shortest, hash_bits(held)), TEXT_ROWS)
    texts = durable(texts.join(held, "line", "left_semi").dropDuplicates(["line"]))
    release(spark)

    groups = durable(rows.select("lead", "line").distinct())
    sizes = groups.groupBy("lead").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / SPLIT_ROWS).cast("int")
    groups = groups.join(sizes, "lead").withColumn("parts", parts).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "lead", "part", "line", (F.pmod("line", "parts") == F.col("part")).alias("probe"))
    sketched = groups.join(texts.select("line", "n", "sketch", *COUNTS), "line")
    some = durable(dealt(sketched).mapInPandas(_with_others(allowed), GROUP_ROWS))
    release(spark)
    links = durable(dealt(some.join(texts, "line")).mapInPandas(_links(allowed), "a long, b long").distinct())
    release(spark)
    return links


def dealt(groups: DataFrame) -> DataFrame:
    """Each group's rows one after the other in one task."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "lead", "part").sortWithinPartitions("lead", "part")


def dropped_lines(docs: DataFrame, t: int = MAX_EDITS, least: int = MIN_LENGTH, id_col: str = "doc_id",
                  text_col: str = "text", share: int | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, n_near, dropped)``, one row per input row.

    ``dropped`` holds the numbers of the document's lines that go (from 0, as split at
    line ends), ``n_near`` how many of them are no exact copy of the line that stays.
    """
    docs, kind = with_text_id(docs, id_col, text_or_empty(F.col(text_col)))
    placed = docs.mapInPandas(_placed, "doc_id string, row long, at int, line long, check long, n int")
    placed = durable(placed.withColumn("doc_id", F.col("doc_id").cast(kind)))
    release(docs.sparkSession)
    size = placed.where("at >= 0").agg(F.sum("n")).first()[0] or 0
    labels = connected_components(line_links(docs, size, t, least, share))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at", "line")
    lines = placed.where("at >= 0").groupBy("line").agg(F.min(place).alias("place"))
    lines = lines.join(labels, F.col("line") == F.col("node"), "left").select(
        "line", "place", F.coalesce("label", "line").alias("comp"))
    first = lines.groupBy("comp").agg(F.min("place").alias("stays"))
    lines = durable(lines.join(first, "comp").select(
        F.col("line").alias("of"), F.col("stays.row").alias("row_0"), F.col("stays.at").alias("at_0"),
        F.col("stays.line").alias("line_0")))
    rows = placed.join(lines, (F.col("line") == F.col("of")) & (F.col("at") >= 0), "left")
    goes = F.col("of").isNotNull() & ((F.col("row") != F.col("row_0")) | (F.col("at") != F.col("at_0")))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count_if(F.col("at") >= 0).alias("n_lines"),
        F.count_if(goes).alias("n_dropped"), F.count_if(goes & (F.col("line") != F.col("line_0"))).alias("n_near"),
        F.array_sort(F.collect_list(F.when(goes, F.col("at")))).alias("dropped")).drop("row")


def without_lines(text: Column, dropped: Column) -> Column:
    """The text without the lines of the given numbers (for rows joined to ``dropped_lines``)."""
    kept = F.filter(F.split(text_or_empty(text), "\n", -1), lambda _, i: ~F.array_contains(dropped, i))
    return F.array_join(kept, "\n")
