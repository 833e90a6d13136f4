"""Grouped and ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. Spark filters ranks before the shuffle too, so few rows a group move."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def ranked(df: DataFrame, group: str, value: str, name: str, order: str = "rank", ranges: int = 64) -> DataFrame:
    """``df`` with each row's rank (or ``row_number``) by ``value`` in its group, for groups that may hold most of the rows.

    Rows are dealt by group and range of values, ranked there, and moved up by the rows of the ranges below, a table of at
    most ``ranges`` rows a group. Bounds are approximate, results exact; rows of one value are always in one range. Null
    values come first.
    """
    bounds = sorted(set(df.agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []))
    number = F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b < F.col(value))), F.lit(-1)) if bounds else F.lit(0)
    rows = df.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(number))
    below = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    inside = Window.partitionBy(group, "_range").orderBy(value)
    rows = rows.withColumn("_own", (F.rank() if order == "rank" else F.row_number()).over(inside))
    out = rows.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(name, F.col("_below") + F.col("_own")).select(*df.columns, name)


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of non-null values per group, by place: no group's values meet in one task."""
    rows = ranked(df.where(F.col(value).isNotNull()).select(group, value), group, value, "_place", "row_number")
    size = rows.groupBy(group).agg(F.count("*").alias("_n"))
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.lit(p) * (F.col("_n") - 1)).alias("at")) for n, p in shares.items())))
    asked = size.select(group, at.alias("a")).select(group, "a.*").select(group, "name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"))
    met = asked.select(F.col(group).alias("_group"), "name", "at", (F.col("k") + 1).alias("_k")).join(rows, F.col("_group").eqNullSafe(F.col(group)) & (F.col("_k") == F.col("_place")))
    low, high = F.min_by(value, "_k"), F.max_by(value, "_k")
    found = met.groupBy("_group", "name", "at").agg((low + (high - low) * (F.max("at") - F.floor(F.max("at")))).alias("v"))
    return found.groupBy(F.col("_group").alias(group)).agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares))


def sessions(df: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """One row per key and session: start, stop and rows; a session ends where no row follows within ``gap``."""
    out = df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("stop"))
    return out.select(key, F.col("w.start").alias("start"), "stop", "n")


def distinct_in_two(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Distinct values per group, deduplicated before the groups meet, so a hot group is counted in parts."""
    return df.select(*group, value).distinct().groupBy(*group).agg(F.count(value).alias(name))
