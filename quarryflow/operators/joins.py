"""Joins that Spark has no operator for, as compositions of ones that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, bucket: Column, name: str | None = None) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` with the same key at or before its ``at`` (null if none).

    ``bucket`` is a coarse, non-decreasing function of ``at``, such as the day. Rows meet per key and bucket, and
    each bucket starts from the last value of the ones before, carried over a table of one row per key and bucket:
    a key with most of the rows is still many small windows. Rows of ``right`` at the same time win by value.
    """
    name = name or value
    columns = left.columns
    l = left.select(*columns, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    missing = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns if c not in (key, at)]
    r = right.where(F.col(value).isNotNull()).select(key, at, *missing, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    rows = l.unionByName(r).withColumn("_bucket", bucket)
    ends = rows.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(at, "_v"))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_bucket", F.last("_end", ignorenulls=True).over(earlier)["_v"].alias("_carried"))
    inside = Window.partitionBy(key, "_bucket").orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    rows = rows.join(ends, [key, "_bucket"], "left")
    return rows.select(*columns, F.coalesce("_own", "_carried").alias(name))


def in_range(points: DataFrame, p: str, ranges: DataFrame, low: str, high: str, width: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with ``low <= p <= high``, and equal ``also`` columns: an equi-join on cells of ``width`` instead of all pairs.

    A range is repeated for each cell that it touches, so ``width`` is best near the usual length of a range.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    a = points.withColumn("_cell", cell(p))
    b = ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return a.join(b, [*also, "_cell"]).where((F.col(p) >= F.col(low)) & (F.col(p) <= F.col(high))).drop("_cell")


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An inner or left join whose left side may have a key with a large share of the rows: its rows go to ``salts``
    tasks, and the right side, of few rows a key, to each of them."""
    if how not in ("inner", "left"):
        raise ValueError("the right side is repeated, so only inner and left joins are right")
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "_salt"], how).drop("_salt")
