"""Which values count as numbers (profile min / max / mean, numeric type inference).

Spark refuses ``try_cast(date|timestamp_ntz|array AS double)`` at analysis time and casts
``timestamp`` to epoch seconds, while the SQL engines the reference targets give NULL for
those.  So only numeric, boolean and string columns are cast; every other type yields
NULL statistics.  Strings are additionally guarded by a plain-decimal pattern because the
two engines disagree on exotic spellings ('1d', '0x1p3', '1_000').
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed value: the plain decimal / scientific spelling accepted as a number in text columns.
NUMERIC_STRING_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric_eligible(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC + (T.BooleanType, T.StringType))


def numeric_value(col: Column, dtype: T.DataType) -> Column:
    """``col`` as a double where it is a number, else NULL (never an analysis error)."""
    if isinstance(dtype, _NUMERIC) or isinstance(dtype, T.BooleanType):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(NUMERIC_STRING_PATTERN), col.try_cast("double"))
    return F.lit(None).cast("double")
