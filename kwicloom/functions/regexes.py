"""Python regular expressions as Spark reads them (Java's dialect)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = False) -> str:
    """The Java form of a Python pattern: Unicode classes, named groups, end of text."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return ("(?iU)" if ignore_case else "(?U)") + out


def search(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern occurs; null is no match."""
    return F.coalesce(col.rlike(java(pattern, ignore_case)), F.lit(False))


def full_match(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern covers the whole value; null is no match."""
    flags, rest = java(pattern, ignore_case)[: 5 if ignore_case else 4], java(pattern, ignore_case)[5 if ignore_case else 4 :]
    return F.coalesce(col.rlike(rf"{flags}\A(?:{rest})\z"), F.lit(False))
