"""Edit distance over bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bytes(c: Column) -> Column:
    """One character for each byte of the UTF-8 form."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance counted in bytes of UTF-8; null if either side is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.levenshtein(_bytes(a), _bytes(b))


def fuzzy_match(a: Column | str, b: Column | str, threshold: int) -> Column:
    """True where the byte edit distance is at most ``threshold``; it stops counting above it."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    d = F.levenshtein(_bytes(a), _bytes(b), threshold)
    return (d >= 0) & (d <= threshold)
