"""Expressions over factor definition text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelwright.functions.scalar import col

# The fields a definition may name, and the text patterns below.
FIELDS = ["open", "high", "low", "close", "volume", "amount", "vwap", "market_cap", "industry"]
LOWER_BOUND = r",?lower=[+-]?\d+(?:\.\d+)?"
UPPER_BOUND = r",?upper=[+-]?\d+(?:\.\d+)?"
BARE_NUMBER = r"(?<![A-Za-z_])\d+(?![A-Za-z_])"
CALL_NAME = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
WORD = r"\b([A-Za-z_][A-Za-z0-9_]*)\b"


def compact(text) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", "")


def structure_signature(text) -> Column:
    """Definition text with clip bounds dropped and whole numbers masked."""
    out = F.regexp_replace(compact(text), LOWER_BOUND, "")
    out = F.regexp_replace(out, UPPER_BOUND, "")
    return F.regexp_replace(out, BARE_NUMBER, "N")


def operator_set(text) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(CALL_NAME), F.lit(1))))


def field_set(text, declared=None) -> Column:
    """Declared fields, or the known field names found in the text."""
    found = F.array_intersect(
        F.array_distinct(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORD), F.lit(1))),
        F.array(*[F.lit(f) for f in FIELDS]),
    )
    if declared is not None:
        found = F.when(F.size(col(declared)) > 0, F.array_distinct(col(declared))).otherwise(found)
    return F.array_sort(found)


def short_hash(text) -> Column:
    return F.substring(F.md5(F.trim(col(text))), 1, 12)


def jaccard(left, right) -> Column:
    """Set overlap; two empty sets count as equal."""
    left, right = col(left), col(right)
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)
