"""Word-shingle sets as sorted 64-bit hashes, and their parity sketches (numpy).

Used inside Spark tasks, one document at a time, so memory is bounded by the
longest text. Words are runs of bytes outside U+0020 and U+0009-U+000D after
lower-casing A-Z; none of these bytes occurs inside a UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_RATIO = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_RATIO, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    t[ord("A"):ord("Z") + 1] = t[ord("a"):ord("z") + 1]
    t[SPACE] = 0
    return t


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = _byte_table()
_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, r in enumerate((_RATIO, _INVERSE)):
            step = np.full(size, r, dtype=_U)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=_U)
    return _powers


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word: polynomial prefix sums, so no loop over words."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=_U)
    space = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum(_TABLE[b] * up[:len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash for each given run of bytes, A-Z as a-z; further seeds give further hashes."""
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=_U)
    np.cumsum(mix(_TABLE + _U(seed))[b] * up[:len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(data: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words.

    Fewer words make one shingle, no word an empty set.
    """
    h = word_hashes(data)
    n = len(h)
    if n == 0:
        return h
    k = min(n, words)
    acc = np.full(n - k + 1, k, dtype=_U)
    for j in range(k):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[j:n - k + 1 + j])
    return np.unique(acc)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit fingerprints of a set, as signed integers."""
    a = int(np.add.reduce(mix(s + _U(0xA5A5A5A5)), dtype=_U)) if len(s) else 0
    b = int(np.bitwise_xor.reduce(mix(s ^ _U(0xC3C3C3C3C3C3)))) if len(s) else 0
    return signed(a), signed(b)


def signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def parity_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """An odd sketch: bit i is the parity of the members hashed to i (``bits`` a power of two).

    Members that two sets share cancel, so the Hamming distance of two sketches
    is at most the size of the sets' symmetric difference.
    """
    at = (mix(s ^ _U(0x5851F42D4C957F2D)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def fold_to(sketch: np.ndarray, n_bytes: int) -> np.ndarray:
    """The same set's sketch of fewer bits: halves XOR together."""
    while len(sketch) > n_bytes:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def parity_words(s: np.ndarray, parts: int, first: int) -> np.ndarray:
    """Keys of the first ``first`` occupied parts of the set.

    The set is dealt to ``parts`` (a power of two) parts by the top bits of its
    hashes; each part's word is the XOR of its members' 64-bit patterns. A member
    in one set only changes one word, so the number of differing words is at most
    the size of the symmetric difference. A key is the word with its part's number.
    """
    if not len(s):
        return s
    part = s >> _U(64 - (parts.bit_length() - 1)) if parts > 1 else np.zeros(len(s), dtype=_U)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    word = np.bitwise_xor.reduceat(mix(s + _U(0x1234567)), at)[:first]
    return mix(word ^ mix(part[at[:first]] * _U(0x2545F4914F6CDD1D) + _U(parts)))
