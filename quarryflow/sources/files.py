"""Sources and sinks by format."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Formats that Spark reads and writes without further jars.
FORMATS = ("parquet", "orc", "json", "csv", "text")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, format: str, schema: StructType | str | None = None, **options: Any) -> DataFrame:
    """A relation of files. Text formats need a schema: inferring one reads the data twice."""
    if format not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str, mode: str = "errorifexists", by: list[str] | None = None, **options: Any) -> None:
    if format not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def rows(df: DataFrame, batch: int = 1000) -> Iterator[list]:
    """Rows to the driver, a partition at a time, in lists of ``batch``."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == batch:
            yield held
            held = []
    if held:
        yield held
