"""Shared plumbing: scratch tables in the cluster's shared folder, and Arrow text columns as numpy bytes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy step holds at once; a longer document is one step of its own.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; set here only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/quarryflow-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a reader of it: later uses neither
    recompute it nor depend on the executors that made it."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, by: str) -> DataFrame:
    """Writes ``df`` once, dealt and bucketed by a column of even values: later joins by it do not move these rows again.

    The catalog names the table only until the reader is made; the files are external and stay as scratch.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"quarryflow_{uuid.uuid4().hex}"
    written = df.repartition(n, by).write.format("parquet").option("compression", "zstd").option("path", scratch(spark, tag))
    written.bucketBy(n, by).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now
    spark.sql(f"drop table {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Workers import this package from where the driver has it, unless it is installed there."""
    home, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (home, known)))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; when they are over, memory that the worker has freed goes back to the system, as workers are kept
    between tasks and an executor's share of memory is theirs together."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row begins in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a column into runs of whole rows of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    data, offsets = raw_text(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def pieces(data: np.ndarray, member: np.ndarray, keep: int, limit: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, int]]:
    """Cuts one row's bytes into parts of at most ``limit`` bytes, each after the ``keep`` words before it: (bytes, how many
    of the first bytes came before). ``member`` tells the bytes of words. Cuts fall between words; only a word of over
    half of ``limit`` bytes may be cut, at a place that its row alone decides."""
    at, before = 0, np.empty(0, np.uint8)
    while True:
        stop = min(len(data), at + limit)
        if stop < len(data) and len(edge := np.flatnonzero(~member[data[at + limit // 2 : stop]])):
            stop = at + limit // 2 + int(edge[-1]) + 1
        part = np.concatenate((before, data[at:stop]))
        yield part, len(before)
        if stop == len(data):
            return
        begins, _, _ = runs(member[part], np.array([0, len(part)]))
        known, at = min(keep, len(begins)), stop
        before = part[begins[-known] :] if known else part[:0]
        if known and member[part[-1]]:  # a word was cut: what follows is another
            before = np.append(before, np.uint8(0x20))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside rows: their starts, their ends, and the first run of each row (and one past the last)."""
    n = len(member)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, ends = member.copy(), member.copy()
    begins[1:] &= ~member[:-1]
    ends[:-1] &= ~member[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    begins[head], ends[tail] = member[head], member[tail]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.searchsorted(begins, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Spans:
    """Hashes of any byte spans of one buffer, two lookups each: a prefix sum of byte times base**position."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=self.sums[1:])
        self.undo = _power("down", _UNDO, n + 1)

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[begins]) * self.undo[begins])

    def windows(self, length: int) -> np.ndarray:
        """Of every span of this length, unmixed positions included by content only."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.undo[:n])


def per_row(weights: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` between consecutive ``firsts``, empty rows included."""
    total = np.concatenate(([0], np.cumsum(weights, dtype=np.float64 if weights.dtype.kind == "f" else np.int64)))
    return total[firsts[1:]] - total[firsts[:-1]]
