"""Null-safe scalar expressions.

Spark runs in ANSI mode by default, so a plain ``/`` raises on zero.  Missing
values are NULL throughout, never NaN: NaN counts in aggregates and sorts last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_double(value: float) -> Column:
    return F.lit(float(value))


def divide(numerator, denominator) -> Column:
    """Quotient in double; NULL when the denominator is zero."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def finite(x) -> Column:
    """NULL out NaN and the two infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def nan_to_null(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def to_number(x) -> Column:
    """Numeric coercion: unreadable text, NaN and infinities become NULL."""
    return finite(F.expr(f"try_cast({x} as double)") if isinstance(x, str) else x.try_cast("double"))


def is_true(flag) -> Column:
    """Three-valued flag test: only an explicit true counts."""
    return F.coalesce(col(flag), F.lit(False))


def signed_power(x, p: float) -> Column:
    x = col(x)
    return finite(F.signum(x) * F.pow(F.abs(x), F.lit(float(p))))


def log1p_abs(x) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x, lower, upper) -> Column:
    """Clip with NULL in, NULL out (``least``/``greatest`` alone skip NULLs)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, col(upper)), col(lower)))


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Apply the NULL-not-NaN rule to every floating column of a scan."""
    return df.select(
        *[
            nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
