"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compact(*items: Column) -> Column:
    """``array(items...)`` without its NULL entries — the 'list of findings' idiom.

    Each item is usually ``F.when(condition, F.struct(...))``; exploding the result gives
    one row per finding without any Python-side loop.
    """
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def fingerprint(col: Column) -> Column:
    """96-bit fingerprint of a (long) string plus its length, for grouping whole texts.

    Grouping on the fingerprint instead of a 20 kB value keeps hash-aggregate key
    comparisons and shuffle keys small; the whole text is still hashed, never a prefix.
    """
    return F.struct(F.xxhash64(col).alias("h64"), F.hash(col).alias("h32"),
                    F.length(col).alias("len"))
