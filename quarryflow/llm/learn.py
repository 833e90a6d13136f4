"""What the two text classifiers share: the fold rule, bounded labelled samples, hashed features, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Spans, lean, mix, per_row, pieces, steps

#: Size of the hashed feature space.
BUCKETS = 1 << 20
_MASK = np.uint64(BUCKETS - 1)

class Features(NamedTuple):
    """How texts become features: ``of`` gives, from bytes and row offsets, the number of each feature occurrence, the first
    occurrence of each row and the size of each row in words, of ``width`` occurrences each. Long rows are read in parts, cut
    between runs of ``member`` bytes and after the ``keep`` runs before; with ``once`` a row's equal words count once."""

    of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    width: int
    member: np.ndarray
    keep: int = 0
    once: bool = False

    def groups(self, column: pa.Array, limit: int) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each run of rows, what ``of`` gives; of a long row, part by part."""
        for a, b, data, offsets in steps(column, limit):
            yield iter([self.of(data, offsets)]) if b - a > 1 or len(data) <= limit else self._parts(data, limit)

    def _parts(self, data: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seen = np.empty(0, np.uint64)
        for part, before in pieces(data, self.member, self.keep, limit):
            words = self.of(part, np.array([0, len(part)]))[0].reshape(-1, self.width)
            words = words[int(self.of(part[:before], np.array([0, before]))[2][0]) if before else 0 :]
            if self.once:
                h = np.zeros(len(words), np.uint64)
                for k in range(self.width):
                    h = mix(h * np.uint64(31) + words[:, k].astype(np.uint64))
                words = words[new := ~np.isin(h, seen)]
                seen = np.concatenate((seen, h[new]))
            yield words.ravel(), np.array([0, words.size]), np.array([len(words)])


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never read; a null id is hashed as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & _MASK).astype(np.int64)


def token_runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one non-zero kind inside rows: begins, ends, row boundaries."""
    n = len(kinds)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    change = np.ones(n + 1, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:-1])
    change[offsets] = True
    edge = np.flatnonzero(change)
    full = kinds[edge[:-1]] > 0
    begins, ends = edge[:-1][full], edge[1:][full]
    return begins, ends, np.searchsorted(begins, offsets)


def sample(ids: DataFrame, size: int, salt: int) -> DataFrame:
    """The ``size`` rows with the smallest hashes of their distinct ids: the same for the same table, however it is split."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(size)


def _counts(batches: Iterator[pa.RecordBatch], features: Features, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for group in features.groups(batch.column("text"), limit):
            rows = [[np.unique(found[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])] for found, first, _ in group]
            if len(rows) > 1:  # the parts of one row
                every, n = (np.concatenate([x[0][k] for x in rows]) for k in (0, 1))
                own, place = np.unique(every, return_inverse=True)
                rows = [[(own, np.bincount(place, n, len(own)))]]
            for k, n in rows[0]:
                ids.append(k.astype(np.uint32).tobytes())
                counts.append(n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes())
        columns = [*(batch.column(c) for c in ("doc_id", "label")), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "ids", "counts"])


Sample = list[tuple[np.ndarray, np.ndarray]]


def gather(docs: DataFrame, chosen: DataFrame, features: Features) -> dict[int, Sample]:
    """By label, (features, counts) of the documents of ``chosen``, a bounded table of distinct (doc_id, label), in the order
    of their ids. Of texts that share an id the least is taken, so the sample is the same however the table is split."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(lambda it: lean(_counts(it, features)), "doc_id long, label int, ids binary, counts binary").collect()
    out: dict[int, Sample] = {}
    for _, label, k, n in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(label, []).append((np.frombuffer(k, np.uint32), np.frombuffer(n, np.uint8 if len(n) < len(k) else np.uint32)))
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _scores(batches: Iterator[pa.RecordBatch], features: Features, weights: np.ndarray, bias: float, mean: bool, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [np.empty(0)]
        for group in features.groups(batch.column("text"), limit):
            total, size = 0, 0
            for found, first, n in group:
                total, size = total + per_row(weights[found], first), size + n
            out.append(logistic(bias + (total / np.maximum(size, 1) if mean else total)))
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(np.concatenate(out), pa.float64())], [*keep, "score"])


def score(docs: DataFrame, features: Features, weights: np.ndarray, bias: float, mean: bool) -> DataFrame:
    """doc_id and score of every row; the model is a fixed ``BUCKETS`` floats, whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    return docs.select("doc_id", "text").mapInArrow(lambda it: lean(_scores(it, features, sent.value, bias, mean)), "doc_id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], features: Features, weights: np.ndarray, bias: float, mean: bool, below: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scored = pa.Table.from_batches(list(_scores(iter([batch.select(["text"])]), features, weights, bias, mean)))
        yield batch.filter(pa.array(scored.column("score").to_numpy() < below))


def keep_below(docs: DataFrame, features: Features, weights: np.ndarray, bias: float, mean: bool, below: float) -> DataFrame:
    """The rows of ``docs`` whose score is under ``below``, with the columns as they came."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    return docs.mapInArrow(lambda it: lean(_kept(it, features, sent.value, bias, mean, below)), docs.schema)


__all__ = ["BUCKETS", "Features", "Spans", "bucket", "gather", "held_out", "keep_below", "logistic", "sample", "score", "token_runs"]
