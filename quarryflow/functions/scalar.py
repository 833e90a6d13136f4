"""Column functions over what Spark has built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(x: Column, default: Column | str) -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def major_version(x: Column) -> Column:
    """The number before the first dot, without a leading v; null where there is none."""
    return F.split_part(F.regexp_replace(x, "^v", ""), F.lit("."), F.lit(1)).try_cast("int")


def affirmative(x: Column, letters: str = "sS") -> Column:
    """Whether an answer is one of these letters and nothing else."""
    return F.coalesce(x.rlike(f"^[{letters}]\\z"), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null where one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
