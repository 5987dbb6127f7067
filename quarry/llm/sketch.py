"""SetSketch registers: truncated logarithms, to a small base, of exponentially spaced minima.

Register i of a set is floor(1 - log_BASE(x_i)), cut to 0..65535, where x_i is the least
of the exponential variables that hash function i gives the elements. The register of a
union is the larger of the two registers, so sketches merge; equal registers are likely
for similar sets, so they serve as locality-sensitive keys; and the counts of larger,
smaller and equal registers give the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

BASE, RATE, REGISTERS, CHUNK = 1.001, 20.0, 112, 2048
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**63, size=(REGISTERS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**64, size=(REGISTERS, 1), dtype=np.uint64, endpoint=False)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


_BYTE = _rng.integers(0, 2**64, size=256, dtype=np.uint64, endpoint=False)
_BASE = int(_rng.integers(2**40, 2**63)) | 1
_POWERS: list[np.ndarray] = []
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: White space of the contracts' words.
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])
PIECE = 1 << 18


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 19, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
        for p in _POWERS:
            np.multiply.accumulate(p, out=p)
    return _POWERS


def _piece_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_LOWER), np.uint8)
    gap = separators[data]
    start = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.take(_BYTE, data) * powers[: len(data)], out=sums[1:])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return scramble((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD[3]), np.diff(np.searchsorted(start, bounds))


def _parts(text: bytes, separators: np.ndarray):
    """A very long text in pieces that end between words."""
    at = 0
    while len(text) - at > 16 * PIECE:
        gaps = np.flatnonzero(separators[np.frombuffer(text, np.uint8, 8 * PIECE, at + 8 * PIECE)])
        if not len(gaps):
            break
        cut = at + 8 * PIECE + int(gaps[0])
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes], separators: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and the number of words of each text.

    Words are what lies between separator bytes, of which the blank is one. Their hashes are
    differences of running sums over the bytes, so that no word is an object of its own.
    """
    hashes, sizes, held, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush():
        found, counts = _piece_hashes([t for _, t in held], separators)
        hashes.append(found)
        np.add.at(sizes, [i for i, _ in held], counts)
        held.clear()

    for i, text in enumerate(texts):
        for part in _parts(text, separators):
            held.append((i, part))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), sizes


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of word hashes; the whole sequence as one if it has fewer than ``k`` words."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(k, len(h))
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x = scramble(x ^ h[i : len(h) - k + 1 + i]) * _ODD[2] + _ODD[3]
    return np.unique(x)


def registers(elements: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit elements."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(elements), CHUNK):
        spread = elements[i : i + CHUNK] * _MUL
        spread += _ADD
        np.minimum(low, spread.min(axis=1), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _apart(x):
    """Probability that one register is larger, and its derivative, by the share of elements on that side only."""
    c = (BASE - 1) / BASE
    return -np.log1p(-x * c) / np.log(BASE), c / (np.log(BASE) * (1 - x * c))


def slope(j, larger, smaller, n_u, n_v):
    """Derivative of the log-likelihood at similarity ``j``: positive where the maximum lies above ``j``."""
    u = n_u / (n_u + n_v)
    v = 1 - u
    up, d_up = _apart(np.maximum(u - v * j, 1e-12))
    down, d_down = _apart(np.maximum(v - u * j, 1e-12))
    equal = REGISTERS - larger - smaller
    return -larger * v * d_up / up - smaller * u * d_down / down + equal * (v * d_up + u * d_down) / (1 - up - down)


def estimate(larger, smaller, n_u, n_v):
    """Similarity of greatest likelihood, by bisection of the (falling) derivative."""
    low = np.zeros(np.shape(larger))
    high = np.minimum(n_u / n_v, n_v / n_u) - 1e-9
    for _ in range(40):
        mid = (low + high) / 2
        above = slope(mid, larger, smaller, n_u, n_v) > 0
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2
