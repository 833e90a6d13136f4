"""Event streams: windowed counts, sessions, deduplication and running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of a folder's event files. Event time must be a timestamp with a zone for watermarks."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; state of windows older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def once(events: DataFrame, late: str) -> DataFrame:
    """Events without repeats of an id that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for batch in batches:
        n, total = n + len(batch), total + float(batch["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running(events: DataFrame) -> DataFrame:
    """Each user's count and sum so far, given whenever the user has new events."""
    return events.groupBy("user_id").applyInPandasWithState(_running, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now and returns what it put out, through files in
    ``folder`` under ``name``: nothing is gathered in the driver. In complete mode the last batch is the result; otherwise all batches are."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/out/batch={number}")  # a batch that is run again replaces itself

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(f"{stream._jdf.schema().toDDL()}, batch long").parquet(f"{folder}/{name}/out")
    last = out.agg(F.max("batch")).first()[0]
    return (out.where(F.col("batch") == last) if mode == "complete" and last is not None else out).drop("batch")
