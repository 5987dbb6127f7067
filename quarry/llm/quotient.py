"""Counting quotient filters over packed n-grams of word ids.

An n-gram of k ids (``bits`` bits each) is a number of k * bits bits, held as two halves. A
Feistel network permutes these numbers invertibly, so that they spread evenly. A filter keeps
them in order, split into a quotient (the top bits) and the full remainder: one bit for each
quotient says whether it has a run, one bit for each slot whether it ends its run, and slots
hold remainder and counter. Nothing is lost: n-grams and counts come back exactly.
"""

from __future__ import annotations

import struct

import numpy as np

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_HEAD = struct.Struct("<BBBBQQ")


def halves(k: int, bits: int) -> tuple[int, int]:
    """Bits of the left and right half of an n-gram of k ids."""
    return bits * (k - k // 2), bits * (k // 2)


def pack(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right halves of n-grams, given the ids at each place."""
    k, out = len(columns), []
    for part in (columns[: k - k // 2], columns[k - k // 2 :]):
        x = np.zeros(len(columns[0]), np.uint64)
        for ids in part:
            x = x << np.uint64(bits) | ids.astype(np.uint64)
        out.append(x)
    return out[0], out[1]


def unpack(left: np.ndarray, right: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Rows of k ids."""
    out, mask = np.empty((len(left), k), np.int64), np.uint64((1 << bits) - 1)
    for half, at, size in ((left, 0, k - k // 2), (right, k - k // 2, k // 2)):
        for j in range(size):
            out[:, at + j] = half >> np.uint64(bits * (size - 1 - j)) & mask
    return out


def _round(x: np.ndarray, constant: int, bits: int) -> np.ndarray:
    x = (x + np.uint64(constant)) * np.uint64(constant | 1)
    x = (x ^ x >> np.uint64(29)) * np.uint64(_MIX[1])
    return (x ^ x >> np.uint64(32)) & np.uint64((1 << bits) - 1)


def permute(left: np.ndarray, right: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = halves(k, bits)
    for i in (0, 2):
        left = left ^ _round(right, _MIX[i], a)
        right = right ^ _round(left, _MIX[i + 1], b)
    return left ^ _round(right, _MIX[0] ^ _MIX[3], a), right


def restore(left: np.ndarray, right: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    a, b = halves(k, bits)
    left = left ^ _round(right, _MIX[0] ^ _MIX[3], a)
    for i in (2, 0):
        right = right ^ _round(left, _MIX[i + 1], b)
        left = left ^ _round(right, _MIX[i], a)
    return left, right


def count(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, k: int, bits: int):
    """Distinct pairs in order, with the sums of their counts (1 each where none are given)."""
    a, b = halves(k, bits)
    if a + b <= 64:
        value = left << np.uint64(b) | right
        order = None if counts is None else np.argsort(value, kind="stable")
        value = np.sort(value) if order is None else value[order]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
        left, right = value[first] >> np.uint64(b), value[first] & np.uint64((1 << b) - 1)
        total = len(value)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(left) else np.empty(0, np.int64)
        total = len(left)
        left, right = left[first], right[first]
    if counts is None:
        sums = np.diff(np.r_[first, total])
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
    return left, right, sums.astype(np.int64)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values_of(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    return out.reshape(-1).view("<u8")


def encode(left: np.ndarray, right: np.ndarray, counts: np.ndarray, k: int, bits: int, top: int = 0) -> bytes:
    """The filter of distinct sorted n-grams that agree in the first ``top`` bits, which are not stored."""
    a, b = halves(k, bits)
    n = len(left)
    q = max(0, min(a - top, max(1, n).bit_length()))
    low = a - top - q
    key = left & np.uint64((1 << a - top) - 1)
    quotient = key >> np.uint64(low)
    used = np.zeros(1 << q, np.uint8)
    used[quotient] = 1
    ends = np.ones(n, np.uint8)
    ends[:-1] = quotient[1:] != quotient[:-1]
    large = np.flatnonzero(counts > 255)  # a counter is one byte; what it cannot hold has its full counter at the end
    small = np.minimum(counts, 255).astype(np.uint8) - (counts > 0)
    small[large] = 255
    widths = (low + 7) // 8, (b + 7) // 8
    parts = [
        _HEAD.pack(q, top, *widths, n, len(large)), np.packbits(used).tobytes(), np.packbits(ends).tobytes(),
        _bytes_of(key & np.uint64((1 << low) - 1), widths[0]), _bytes_of(right, widths[1]), small.tobytes(),
        large.astype("<u8").tobytes(), counts[large].astype("<u8").tobytes(),
    ]
    return b"".join(parts)


def decode(raw: bytes, k: int, bits: int, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``encode`` was given; ``prefix`` is the first ``top`` bits."""
    a, _ = halves(k, bits)
    q, top, wl, wr, n, wide = _HEAD.unpack_from(raw)
    at = _HEAD.size

    def take(size):
        nonlocal at
        at += size
        return raw[at - size : at]

    used = np.flatnonzero(np.unpackbits(np.frombuffer(take((1 << q) + 7 >> 3), np.uint8), count=1 << q))
    ends = np.unpackbits(np.frombuffer(take(n + 7 >> 3), np.uint8), count=n).astype(np.int64)
    low = a - top - q
    quotient = used[np.cumsum(ends) - ends].astype(np.uint64) if n else np.empty(0, np.uint64)
    left = quotient << np.uint64(low) | _values_of(take(n * wl), n, wl)
    left |= np.uint64(prefix << a - top if top else 0)
    right = _values_of(take(n * wr), n, wr)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64) + 1
    places = np.frombuffer(take(8 * wide), "<u8").astype(np.int64)
    counts[places] = np.frombuffer(take(8 * wide), "<u8").astype(np.int64)
    return left, right, counts


def merge(filters: list[tuple], k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The decoded sum of decoded filters."""
    return count(*(np.concatenate(x) for x in zip(*filters)), k, bits)
