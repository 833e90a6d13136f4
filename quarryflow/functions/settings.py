"""Settings files as relations: KEY=value lines in, key and value rows out; never evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """key and value of each assignment; comments, blank lines and lines without ``=`` give nothing; quotes around a
    value go. A null line gives nothing; a key given twice gives two rows."""
    text = F.regexp_replace(F.trim(line), r"^export\s+", "")
    found = lines.select(text.alias("_t")).where(F.col("_t").rlike(r"^[A-Za-z_][A-Za-z0-9_]*="))
    value = F.regexp_replace(F.regexp_extract("_t", r"^[^=]*=(.*)$", 1), r"^(['\"])(.*)\1$", "$2")
    return found.select(F.split_part("_t", F.lit("="), F.lit(1)).alias("key"), value.alias("value"))


def upsert(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Settings with the keys of ``changes`` set to their values. A key must be given once on each side."""
    both = settings.select("key", "value", F.lit(0).alias("_n")).unionByName(changes.select("key", "value", F.lit(1).alias("_n")))
    return both.groupBy("key").agg(F.max_by("value", "_n").alias("value"))


def append_absent(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` and those of ``more`` whose keys they lack: doing it twice changes nothing."""
    return rows.unionByName(more.dropDuplicates(on).join(rows, on, "left_anti").select(*rows.columns))


def first_present(candidates: DataFrame, present: DataFrame, group: str, name: str, place: str) -> DataFrame:
    """For each group, the first candidate by ``place`` that ``present`` has; groups without one give no row."""
    found = candidates.join(present.select(name).distinct(), name, "left_semi")
    return found.groupBy(group).agg(F.min_by(name, place).alias(name))


def latest(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; of equal ones, one."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return versions.withColumn("_n", n).where("_n = 1").drop("_n")
