"""Words that must follow each other in a text, matched in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column


def shortest(words: list[str]) -> list[str]:
    """The words that contain no other one: where a longer one stands, a shorter one stands too and ends no later."""
    lower = {w.lower() for w in words}
    return sorted(w for w in lower if not any(v != w and v in w for v in lower))


def pattern(*groups: list[str]) -> str:
    """A pattern for texts with a word of each group, one after the other without overlap.

    Each group takes the first place after the one before and never gives it up (an atomic
    group): with words that do not contain each other the first to start is the first to end,
    so a later place could not help the groups that follow. The text is read once, whatever
    its length.
    """
    return "(?>.*?(?:" + "))(?>.*?(?:".join("|".join(map(re.escape, shortest(g))) for g in groups) + "))"


def follow(text: Column, *chains: tuple[list[str], ...]) -> Column:
    """Whether one of the chains is in the text; letters in any case."""
    return text.rlike(r"(?ius)\A(?:" + "|".join(pattern(*c) for c in chains) + ")")


def holds(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text; letters in any case."""
    return follow(text, (words,))


def whole(text: Column, words: list[str]) -> Column:
    """Whether the text is one of the words; letters in any case."""
    return text.rlike(r"(?iu)\A(?:" + "|".join(map(re.escape, words)) + r")\z")


def product(*parts: str) -> list[str]:
    """Each word of the first part before each of the next, and so on; parts are written ``a|b|c``, a part may have an empty word."""
    out = [""]
    for part in parts:
        out = [a + b for a in out for b in part.split("|")]
    return out

