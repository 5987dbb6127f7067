"""Cheapest repair of a run of conversation turns, by depth-first branch and bound.

A run is a list of items in order: a turn that must go (``Forced``), or one that may be kept,
given another role or deleted (``Free``). The roles that are left must read ``(s?(ua)+)?``.
A state says what was emitted last: nothing, system, user or assistant.

The search keeps an explicit stack of prefixes, an incumbent (cost, audit), a lower bound of
each suffix and, for each node (item, state), a table of the least cost of a prefix that came
there. Two prefixes of one node and equal cost insert as many turns, so neither is the beginning
of the other, and the lesser one stays lesser whatever follows.
"""

from __future__ import annotations

from typing import NamedTuple

START, SYSTEM, USER, ASSISTANT, FINISH = range(5)
RERUN, DROP, PUT = 2, 3, 2
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LAST = {SYSTEM: "s", USER: "u", ASSISTANT: "a", FINISH: "a"}
_PAIRED = ("u", "a")


class Forced(NamedTuple):
    """So many turns in a row that must be deleted."""

    copies: int


class Free(NamedTuple):
    """A turn that may stay: its role's initial, and what it costs unless it is deleted."""

    initial: str
    extra: int


class Suffixes:
    """Lower bounds of what the items from one on cost, by state.

    Forced deletions cost their price and cut-off turns their extra. A turn that is neither
    user nor assistant must be edited (2 at least); only one system turn may stay, and only
    while nothing has been emitted. Between the others, a pair of neighbours that may not
    follow each other is a break. An edit of price 2 mends one break, or two in a row, and a
    deletion (3) no more, or it also saves an extra of 1. So a chain of m breaks in a row costs
    at least 2 * ceil(m / 2).
    """

    def __init__(self, items: list, goal: int):
        n = len(items)
        self.items, self.goal, self.last = items, goal, _LAST.get(goal)
        self.fixed, self.ahead = [0] * (n + 1), [-1] * (n + 1)
        self.rest, self.chain, self.system = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            item, after = items[i], self.ahead[i + 1]
            self.system[i] = self.system[i + 1]
            if isinstance(item, Forced):
                self.fixed[i], self.ahead[i] = self.fixed[i + 1] + DROP * item.copies, after
                continue
            self.fixed[i], self.ahead[i] = self.fixed[i + 1] + item.extra, i
            if item.initial not in _PAIRED:
                self.system[i] |= item.initial == "s"
                self.rest[i] = (self.rest[after] if after >= 0 else 0) + RERUN
                continue
            if after < 0:
                broken, rest, chain = self.last != item.initial, 0, 0
            else:
                then = items[after].initial
                broken, rest, chain = then == item.initial, self.rest[after], self.chain[after]
            self.chain[i] = chain + 1 if broken else 0
            self.rest[i] = rest + 2 if broken and chain % 2 == 0 else rest

    def least(self, i: int, state: int) -> int:
        j = self.ahead[i]
        if j < 0:
            done = state == self.goal or self.goal == FINISH and state in (START, ASSISTANT)
            return self.fixed[i] + (0 if done else 2)
        first = self.items[j].initial
        broken = first in _PAIRED and (state, first) not in _NEXT
        low = self.fixed[i] + self.rest[j] + (2 if broken and self.chain[j] % 2 == 0 else 0)
        return low - RERUN if state == START and self.system[j] else low


def search(items: list, entry: int = START, goal: int = FINISH) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``entry`` to ``goal``, or None where nothing does.

    Audit letters: K keeps a turn, R gives it the wanted role, D deletes it, I inserts one.
    Inside a run (``goal`` a state) turns are inserted before an item only; at the end of a
    conversation (``FINISH``) also after the last. Of equal costs the least audit wins.

    The first descent takes the most promising edit of each node first and proves the cost.
    The second takes edits by letter, so it meets audits in their order: the first complete one
    of that cost is the least. A node is opened again only at a lower cost, so at most as often
    as the gap between cost and bound, whatever the number of equally good audits.
    """
    bounds = Suffixes(items, goal)
    found = _descend(items, entry, goal, bounds, None)
    return found and _descend(items, entry, goal, bounds, found[0])


def _descend(items: list, entry: int, goal: int, bounds: Suffixes, price: int | None) -> tuple[int, str] | None:
    """One depth-first descent; with ``price`` known, the least audit of that cost."""
    n = len(items)
    incumbent: tuple[int, str] | None = None
    limit = float("inf") if price is None else price + 1  # a prefix must promise less
    table: dict[tuple[int, int], int] = {}
    stack: list[tuple] = [(0, entry, 0, None)]
    while stack:
        i, state, cost, trail = stack.pop()
        if cost + bounds.least(i, state) >= limit or table.get((i, state), limit) <= cost:
            continue
        table[i, state] = cost
        if i == n and (state == goal or goal == FINISH and state in (START, ASSISTANT)):
            incumbent, limit = (cost, trail), cost
            if price is not None:
                break
            continue
        put = _NEXT[state, "a" if state == USER else "u"]
        steps = []
        if i < n:
            item = items[i]
            if isinstance(item, Forced):
                steps.append((i + 1, state, cost + DROP * item.copies, (trail, "D" * item.copies)))
            else:
                steps.append((i + 1, state, cost + DROP, (trail, "D")))
        if i < n or goal == FINISH:
            steps.append((i, put, cost + PUT, (trail, "I")))
        if i < n and isinstance(item, Free):
            kept = _NEXT.get((state, item.initial))
            if kept:
                steps.append((i + 1, kept, cost + item.extra, (trail, "K")))
            if kept != put:
                steps.append((i + 1, put, cost + RERUN + item.extra, (trail, "R")))
        if goal <= SYSTEM:  # nothing leads back there
            steps = [s for s in steps if s[1] <= goal]
        if price is None:
            steps.sort(key=lambda s: s[2] + bounds.least(s[0], s[1]))
        stack += reversed(steps)
    if incumbent is None:
        return None
    cost, trail = incumbent
    letters = []
    while trail:
        trail, letter = trail
        letters.append(letter)
    return cost, "".join(reversed(letters))
