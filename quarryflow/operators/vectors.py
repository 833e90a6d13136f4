"""Nearest vectors by cosine: exact, over products of matrices."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups

#: Asked vectors of a block, rows of a part, and the numbers that a block or a product holds at most.
BLOCK, PART, HELD = 8192, 1 << 18, 1 << 21


def _finder(k: int, scale: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (cell, given, id, v) that come sorted by cell, the asked before the given: each asked row's ``k`` nearest."""
    nan, null, none = scale + 1, -scale - 1, -scale - 2  # rounded likenesses are whole numbers between these

    def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows over their lengths, and their numbers of numbers: -1 where one is null or there is none."""
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = column.flatten()
        row = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(row[pc.is_null(x).to_numpy(zero_copy_only=False)], minlength=len(size)) > 0
        m = np.zeros((len(size), size.max(initial=0)))
        m[np.arange(m.shape[1]) < size[:, None]] = pc.fill_null(x, 0).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
        return m, np.where(bad | (size == 0), -1, size)

    def likenesses(e: np.ndarray, e_size: np.ndarray, v: np.ndarray, v_size: np.ndarray) -> np.ndarray:
        width = min(e.shape[1], v.shape[1])  # rows of unequal sizes are null
        with np.errstate(invalid="ignore"):
            s = (e[:, :width] @ v[:, :width].T) * scale
            s = np.trunc(s + np.copysign(0.5, s))
        s[np.isnan(s)] = nan
        if (e_size != e_size[0]).any() or (v_size != e_size[0]).any() or e_size[0] < 0:
            s[(e_size[:, None] != v_size) | (e_size[:, None] < 0)] = null
        return s.astype(np.int64)

    def nearest(asked: np.ndarray, e: np.ndarray, e_size: np.ndarray, ids: np.ndarray, v: np.ndarray, v_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likenesses and ids of these rows, which come sorted by id."""
        n, bits = len(ids), max(1, len(ids)).bit_length()
        s = likenesses(e, e_size, v, v_size)
        first, past = np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right")
        for a in np.flatnonzero(first < past):
            s[a, first[a] : past[a]] = none
        s = (s << bits) + np.arange(n - 1, -1, -1)  # of equal ones the smaller id is the larger number
        if n > k:
            s = np.partition(s, n - k, axis=1)[:, n - k :]
        return s >> bits, ids[n - 1 - (s & ((1 << bits) - 1))]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, block, best = None, [], None, None

        def answer() -> pa.RecordBatch:
            s, ids = best
            keep = s > none
            asked = np.broadcast_to(block[0][:, None], s.shape)[keep]
            s = s[keep]
            alike = pa.array(np.where(s == nan, np.nan, s / scale), mask=s == null)
            return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids[keep]), alike], ["asked", "id", "alike"])

        for batch in batches:
            own, given = batch.column("cell").to_numpy(), batch.column("given").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((own[1:] != own[:-1]) | (given[1:] != given[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(own)]) if len(own) else ():
                if own[a] != cell:
                    if best is not None:
                        yield answer()
                    cell, waiting, block, best = own[a], [], None, None
                part = batch.slice(a, b - a)
                if not given[a]:
                    waiting.append(part)
                    continue
                if not waiting:  # nobody asks here
                    continue
                if block is None:
                    all_ = pa.Table.from_batches(waiting).combine_chunks()
                    block = (all_.column("id").to_numpy(), *units(all_.column("v").combine_chunks()))
                    best = np.full((len(block[0]), k), none), np.zeros((len(block[0]), k), np.int64)
                part = part.take(pa.array(np.argsort(part.column("id").to_numpy(), kind="stable")))
                step = max(1, min(part.num_rows, held // max(1, block[1].shape[1])))
                for c in range(0, part.num_rows, step):
                    rows = part.slice(c, step)
                    ids, (v, v_size) = rows.column("id").to_numpy(), units(rows.column("v"))
                    few = max(1, held // rows.num_rows)
                    for d in range(0, len(block[0]), few):
                        some = slice(d, d + few)
                        s, found = nearest(*(x[some] for x in block), ids, v, v_size)
                        s, found = np.concatenate((best[0][some], s), 1), np.concatenate((best[1][some], found), 1)
                        order = np.lexsort((found, -s), axis=1)[:, :k]
                        best[0][some], best[1][some] = np.take_along_axis(s, order, 1), np.take_along_axis(found, order, 1)
        if best is not None:
            yield answer()

    return met


def nearest(df: DataFrame, id_: str, vector: str, asks: Column, k: int, decimals: int = 6) -> DataFrame:
    """(asked, id, alike): the ``k`` nearest rows of ``df``, by rounded cosine and then the smaller id, of each row that asks.

    Blocks of the asking meet parts of the table: a task is one block and one part, holds the block and streams the part.
    Ids are longs; a row of a null id neither asks nor is found, and one is not found by its own id. The cosine with a
    vector of zeros is NaN, which comes first; with a null or empty one, or one of another size, it is null and comes last.
    """
    rows = df.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(asking / max(1, min(BLOCK, HELD // max(1, width or 0)))))
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / PART), min(math.ceil(tasks / blocks), math.ceil(n / 2048)))
    dealt = F.xxhash64("id", "v")
    block, part = F.pmod(dealt, F.lit(blocks)).cast("int"), F.pmod(F.shiftright(dealt, 20), F.lit(parts)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    given = rows.select(part.alias("part"), each(blocks).alias("block"), F.lit(True).alias("given"), "id", "v")
    asked = rows.where("asks").select(each(parts).alias("part"), block.alias("block"), F.lit(False).alias("given"), "id", "v")
    met = asked.unionByName(given).select((F.col("part") * blocks + F.col("block")).alias("cell"), "given", "id", "v")
    met = met.repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "given")
    found = met.mapInArrow(_finder(k, 10**decimals, HELD), "asked long, id long, alike double")
    return groups.top_per_group(found, ["asked"], [F.desc("alike"), F.col("id")], k)
