"""Text expressions: Python's idea of white space in Catalyst's terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what Python's str.strip and str.split take for white space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def clean(text: Column, spaces: bool = True, newlines: bool = True) -> Column:
    """Runs of spaces and tabs to one space, three or more newlines to two, no space at the ends. Entities are decoded before."""
    if spaces:
        text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")  # a single space stays as it is
    if newlines:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def word_count(text: Column) -> Column:
    """Pieces between white space: one character of it is a plain split, which needs no regex engine."""
    even = F.translate(text, SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(even, " "), ""))


def accepted(text: Column, least: int = 100, most: int = 1_000_000) -> Column:
    """Null where shorter than `least`, cut at `most`."""
    return F.when(F.length(text) >= least, F.substring(text, 1, most))
