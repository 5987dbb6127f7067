"""Content-defined anchors of byte strings, and longest-previous-factor arrays.

Every string of ``SPAN`` bytes has one anchor: the leftmost of its ``GRAM``-byte grams with
the least hash. The anchor depends on the string's content alone, so equal strings have
equal anchors at equal offsets. Consecutive starts that share an anchor form a run; runs
are some 35 starts long, so they are a small table that can be shuffled.
"""

from __future__ import annotations

import numpy as np

SPAN, GRAM = 100, 32
WINDOW = SPAN - GRAM + 1
_rng = np.random.default_rng(9)
_BYTES = _rng.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_BASE = [int(x) | 1 for x in _rng.integers(2**40, 2**63, size=2)]
_POWERS: list[list[np.ndarray]] = [[], []]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    held = _POWERS[which]
    if not held or len(held[0]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        base, inverse = _BASE[which], pow(_BASE[which], -1, 2**64)
        held[:] = [np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)]) for b in (base, inverse)]
        for p in held:
            np.multiply.accumulate(p, out=p)
    return held[0][:n], held[1][:n]


def _prefix(which: int, data: np.ndarray) -> np.ndarray:
    powers, _ = _powers(which, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * powers[: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def runs(data: np.ndarray, ends: np.ndarray):
    """Runs of the concatenated documents that end at ``ends``.

    Gives, for each run, its first start, its number of starts, the hash of its anchor's
    gram and a second hash of the whole block that its strings cover. Strings never cross
    the end of a document.
    """
    n = len(data) - SPAN + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none
    prefix = _prefix(0, data)
    _, inverse = _powers(0, len(data) + 1)
    grams = len(data) - GRAM + 1
    keys = mix((prefix[GRAM:] - prefix[:grams]) * inverse[:grams])
    # The least gram of each window by doubling; the position breaks ties to the left.
    rank = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    best, width = rank, 1
    while width * 2 <= WINDOW:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < WINDOW:
        best = np.minimum(best[: n], best[WINDOW - width : WINDOW - width + n])
    anchor = (best[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(n, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - SPAN + 1) : e] = False
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    start = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= (anchor[:-1] != anchor[1:]) | ~valid[1:]
    count = np.flatnonzero(last) - start + 1
    at = anchor[start]
    prefix = _prefix(1, data)
    _, inverse = _powers(1, len(data) + 1)
    block = (prefix[start + count - 1 + SPAN] - prefix[start]) * inverse[start]
    block = mix(block + (at - start).astype(np.uint64) * _M1 + count.astype(np.uint64) * _M2)
    return start, count, keys[at].view(np.int64), block.view(np.int64)


def previous_factors(suffixes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes (rows of ``SPAN`` bytes) that come in suffix order.

    ``order`` is each suffix's place in the text. The nearest suffixes before and after, in
    suffix order, whose place is smaller share the longest prefix with it that any earlier
    place does; both are found by pointer jumping over the array.
    """
    n = len(order)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    rows = suffixes.view(np.uint8).reshape(n, -1)
    for step in (-1, 1):
        near = np.arange(n) + step
        place = np.append(order, np.int64(-1))  # beyond either end: smaller than all
        near[(near < 0) | (near >= n)] = n
        moving = np.flatnonzero((near < n) & (place[near] >= place[:n]))
        while len(moving):
            # A pointer that stands on a larger place follows that one's pointer.
            near[moving] = near[near[moving]]
            moving = moving[(near[moving] < n) & (place[near[moving]] >= order[moving])]
        has = np.flatnonzero(near < n)
        for part in np.array_split(has, max(1, len(has) // 100_000)):
            same = rows[part] == rows[near[part]]
            length = np.where(same.all(1), rows.shape[1], same.argmin(1))
            longest[part] = np.maximum(longest[part], length)
    return longest
