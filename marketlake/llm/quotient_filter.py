"""Counting quotient filters over 128-bit keys, lossless (numpy).

A key (two 64-bit halves) is permuted by an invertible Feistel network, so the
permuted keys are spread evenly whatever the keys are. The top bits name a shard, the
next ``q`` bits are the quotient and what is left the remainder, stored in full: the
permutation taken back gives the key itself. A filter is sorted by (quotient,
remainder) and stores

- the quotients as one unary run a slot: as many ones as keys, then a zero;
- the remainders in the bytes their width needs;
- the counters as one byte, those of 255 or more beside, in full.

With about one key a slot a key takes 14 bytes, against 24 of two halves and a counter.
Sorted filters of one shard merge into one; equal keys add their counters.
"""

from __future__ import annotations

import struct

import numpy as np

from .shingles import mix

_U = np.uint64
_ROUNDS = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_HEAD = "<qqBB"
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def permute(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for c in _ROUNDS:
        x, y = y, x ^ mix(y + c)
    return x, y


def restore(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    for c in reversed(_ROUNDS):
        x, y = y ^ mix(x + c), x
    return x, y


def collapse(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Counts:
    """Sorted by (hi, lo), the counts of equal keys added."""
    if not len(hi):
        return hi, lo, n
    order = np.argsort(hi, kind="stable")
    h, l = hi[order], lo[order]
    same = h[1:] == h[:-1]
    if (same & (l[1:] != l[:-1])).any():
        order = np.lexsort((lo, hi))
        h, l = hi[order], lo[order]
        same = h[1:] == h[:-1]
    at = np.flatnonzero(np.append(True, ~same | (l[1:] != l[:-1])))
    return h[at], l[at], np.add.reduceat(n[order], at)


def pack(counts: Counts, shard: int, shard_bits: int) -> bytes:
    """The filter of one shard's sorted permuted keys."""
    hi, lo, n = counts
    m = len(hi)
    q = min(max(m - 1, 0).bit_length(), 48, 64 - shard_bits)
    width = 64 - shard_bits - q
    inside = hi & _U((1 << (64 - shard_bits)) - 1)
    quotient = (inside >> _U(width)).astype(np.int64) if width < 64 else np.zeros(m, dtype=np.int64)
    slots = np.ones(m + (1 << q), dtype=np.uint8)
    slots[np.cumsum(np.bincount(quotient, minlength=1 << q)) + np.arange(1 << q)] = 0
    rest = np.ascontiguousarray((inside & _U((1 << width) - 1)).astype("<u8")).view(np.uint8).reshape(m, 8)
    large = n[n >= 255]
    return b"".join((
        struct.pack(_HEAD, m, len(large), q, shard_bits), np.packbits(slots).tobytes(),
        rest[:, :(width + 7) // 8].tobytes(), lo.astype("<u8").tobytes(),
        np.minimum(n, 255).astype(np.uint8).tobytes(), large.astype("<i8").tobytes()))


def unpack(data: bytes, shard: int) -> Counts:
    m, n_large, q, shard_bits = struct.unpack_from(_HEAD, data)
    width, at = 64 - shard_bits - q, struct.calcsize(_HEAD)
    n_slots = m + (1 << q)

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, dtype=np.uint8, count=size, offset=at - size)

    slots = np.unpackbits(take((n_slots + 7) // 8), count=n_slots)
    quotient = np.cumsum(slots == 0)[slots == 1].astype(_U)
    rest = np.zeros((m, 8), dtype=np.uint8)
    rest[:, :(width + 7) // 8] = take(m * ((width + 7) // 8)).reshape(m, -1)
    hi = rest.reshape(-1).view("<u8").astype(_U)
    if width < 64:
        hi |= quotient << _U(width)
    if shard_bits:
        hi |= _U(shard << (64 - shard_bits))
    lo = take(8 * m).view("<u8").astype(_U)
    n = take(m).astype(np.int64)
    n[n == 255] = take(8 * n_large).view("<i8")
    return hi, lo, n


def merge(filters: list[Counts]) -> Counts:
    return collapse(*(np.concatenate(part) for part in zip(*filters)))


def by_shard(counts: Counts, shard_bits: int):
    """``(shard, packed filter)`` of each shard that has keys."""
    hi, lo, n = counts
    if not len(hi):
        return
    shard = (hi >> _U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(hi), dtype=np.int64)
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for a, b in zip(at, np.append(at[1:], len(shard))):
        yield int(shard[a]), pack((hi[a:b], lo[a:b], n[a:b]), int(shard[a]), shard_bits)
