"""White space as Unicode has it: one set of characters for every trim and squeeze."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tab to carriage return, the four separators 1C to 1F, and every space, line and paragraph separator of Unicode.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def _text(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(column: Column | str) -> Column:
    """Without white space at either end; null is the empty text."""
    return F.trim(_text(column), F.lit(WHITE))


def squeeze(column: Column | str) -> Column:
    """Without any white space; null is the empty text."""
    return F.translate(_text(column), WHITE, "")


def single(column: Column | str) -> Column:
    """Stripped, each run of white space as one blank."""
    return F.regexp_replace(strip(column), f"[{WHITE}]+", " ")
