"""Document fingerprints by improbable features.

Every 32-byte window of a text has a byte entropy. Windows are ranked by how rare that entropy is: ``rarity`` counts
the entropies of all windows of the corpus, and the fewer windows have one, the rarer it is; windows that hardly vary are
left out. Of any 32 neighbouring windows the rarest, leftmost first, scores a point, and windows of ``POINTS`` or more
become features. A feature sets five bits of a 2048-bit Bloom filter; a filter takes ``PER_FILTER`` features, then the
next of the chain begins. Fingerprints compare where they were made with the same ranks.

Two chains are compared filter by filter: the bits that two filters share, over what chance gives them and a
margin, as a share of the most they could have in common; each filter of the shorter chain takes its best
partner, and the mean is the likeness.

``edited`` pairs each row with the next one, by descending doc_id and after the last the first. Rows are dealt by
ranges of that order and walked in it, so neighbours meet in one sorted stream; of each range the first row and the last
are also taken out, and those few are paired with the ranges beside them.

Defined cases: a null text is empty; a text with no feature (short, or hardly varied) has its 8-byte windows as features,
or its whole where it has none, so equal texts are always alike; a null doc_id comes last; rows that share a doc_id follow
each other by text, and ranges cut between them by its first ``PREFIX`` characters; a table of one row is its own
neighbour; other columns are ignored; an empty table gives no rows. Texts of over ``LONG`` bytes are read in parts. Two
chains are compared filter by filter, which for two very long texts is the product of their lengths.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Spans, mix, steps

WINDOW, NEIGHBOURS, POINTS, SHORT = 32, 32, 8, 8
BITS, PER_FILTER, MARGIN = 2048, 160, 0.1
#: Thousandths of the largest entropy: the least that a feature has.
LEAST = 100
#: Characters of a text that tell ranges apart where ids are equal, and bytes of a text that are read at once.
PREFIX, LONG = 256, 1 << 20

_C = np.arange(WINDOW + 2, dtype=np.float64)
_TOTAL = np.rint(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * (1 << 20)).astype(np.int64)
#: What the sum of c log c over a window's byte counts gains when a count reaches c.
_GAIN = np.diff(_TOTAL, prepend=0)
_FULL = _TOTAL[WINDOW]


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, in thousandths of the largest, of the window that begins at each byte that begins one."""
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)  # the same byte among so many bytes on one side, itself included
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        before[d:] += same
        after[:-d] += same
    gained, lost = np.cumsum(_GAIN[before]), np.cumsum(_GAIN[after])
    total = gained[WINDOW - 1 :].copy()
    total[1:] -= lost[: n - WINDOW]
    return (_FULL - total) * 1000 // _FULL


def _valid(offsets: np.ndarray, starts: int) -> np.ndarray:
    """Which places begin a window that lies in one row."""
    edge, long = np.zeros(starts + WINDOW, np.int64), np.diff(offsets) >= WINDOW
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - WINDOW + 1, -1)
    return np.cumsum(edge[:starts]) > 0


def _blocks(data: np.ndarray, more: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where each part of a row begins, and its bytes: its own and ``more`` that follow."""
    for at in range(0, max(len(data), 1), LONG):
        yield at, data[at : at + LONG + more]


def _entropy_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1001, np.int64)
    for batch in batches:
        for a, b, data, offsets in steps(batch.column("text"), LONG):
            if b - a > 1:
                value = entropies(data)
                count += np.bincount(value[_valid(offsets, len(value))], minlength=1001)
            else:
                for _, part in _blocks(data, WINDOW - 1):
                    count += np.bincount(entropies(part), minlength=1001)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["value", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy, 0 to 1000: how many entropies fewer windows of the whole corpus have."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_entropy_counts, "value long, n long")
    count = np.zeros(1001, np.int64)
    for value, n in found.groupBy("value").agg(F.sum("n").alias("n")).collect():  # 1,001 rows at most
        count[value] = n
    return np.argsort(np.argsort(count, kind="stable"))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of x[i : i + size], shorter at the end; ``size`` is a power of two."""
    x, step = x.copy(), 1
    while step < size:
        x[:-step] = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:-step]
        step *= 2
    return x


def _chosen(data: np.ndarray, valid: np.ndarray, rank: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that are the rarest of some neighbours among the first ``own``: their places, points and hashes."""
    value = entropies(data)
    key = np.where(valid, np.where(value < LEAST, 2000, rank[value]) << 40 | np.arange(len(value)), np.int64(1) << 60)
    at, points = np.unique(_sliding_min(key, NEIGHBOURS)[:own][valid[:own]], return_counts=True)
    at, points = (at & ((1 << 40) - 1))[at >> 40 < 2000], points[at >> 40 < 2000]
    return at, points, Spans(data).windows(WINDOW)[at]


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each row, and the first of each row."""
    starts = len(data) - WINDOW + 1
    if starts <= 0:
        return _bare(data, offsets, np.arange(len(offsets) - 1), np.empty(0, np.int64), np.empty(0, np.uint64))
    if len(offsets) == 2:
        found = []
        for a, part in _blocks(data, WINDOW + NEIGHBOURS - 2):
            if len(part) >= WINDOW:
                at, points, h = _chosen(part, np.ones(len(part) - WINDOW + 1, bool), rank, LONG)
                found.append((at + a, points, h))
        at, points, h = (np.concatenate(x) for x in zip(*found))
        at, first, place = np.unique(at, return_index=True, return_inverse=True)
        points, h = np.bincount(place, points).astype(np.int64), h[first]
    else:
        at, points, h = _chosen(data, _valid(offsets, starts), rank, starts)
        order = np.argsort(at)
        at, points, h = at[order], points[order], h[order]
    at, h = at[points >= POINTS], h[points >= POINTS]
    row = np.searchsorted(offsets, at, "right") - 1
    return _bare(data, offsets, np.setdiff1d(np.arange(len(offsets) - 1), row), row, h)


def _bare(data: np.ndarray, offsets: np.ndarray, bare: np.ndarray, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the features of the rows that have none yet; each hash once in a row, in the text's order."""
    begins, ends = offsets[:-1][bare], offsets[1:][bare]
    n = np.maximum(ends - begins - SHORT + 1, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
    none = n == 0
    spans = Spans(data if len(bare) else data[:0])
    row = np.concatenate((row, np.repeat(bare, n), bare[none]))
    h = np.concatenate((h, spans.of(at, at + SHORT), mix(spans.of(begins[none], ends[none]) + np.uint64(1))))
    order = np.argsort(row, kind="stable")
    row, h = row[order], h[order]
    once = np.sort(np.unique(h + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)[1])
    row, h = row[once], h[once]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def chains(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The Bloom filters of each text, one per line of 256 bytes."""
    out = []
    for _, _, data, offsets in steps(pa.array(texts, pa.large_binary())):
        h, first = features(data, offsets, rank)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            own = h[a:b]
            line = np.arange(b - a) // PER_FILTER * BITS
            bits = np.zeros(((b - a - 1) // PER_FILTER + 1) * BITS, np.uint8)
            for k in range(5):
                bits[line + (own >> np.uint64(11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
            out.append(np.packbits(bits).reshape(-1, BITS // 8))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    if a.shape == b.shape and (a == b).all():
        return 1.0
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64)[:, None], np.bitwise_count(b).sum(1, dtype=np.int64)[None, :]
    most = np.minimum(na, nb)
    chance = na * nb / BITS
    floor = chance + MARGIN * (most - chance)
    best = np.zeros(len(a))
    for k in range(len(a)):
        common = np.bitwise_count(a[k] & b).sum(1, dtype=np.int64)
        best[k] = np.clip((common - floor[k]) / np.maximum(most[k] - floor[k], 1e-9), 0, 1).max()
    return float(best.mean())


def printed(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edit(text: str, following: str) -> str:
    """The last third of a text's code points replaced by as many of the following text's first, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Characters of text that are fingerprinted together.
TOGETHER = 1 << 21


def _answers(ids: list, texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray], rank: np.ndarray) -> pa.RecordBatch:
    changed = [edit(t, f).encode() for t, f in zip(texts, following)]
    rows = [
        (i, len(t), hashlib.sha256(e).hexdigest(), printed(a), printed(c), likeness(a, c), likeness(a, b))
        for i, t, e, a, b, c in zip(ids, texts, changed, own, after, chains(changed, rank))
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _OUT.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text): what is asked of each but the last, which has no next here."""
    held: list[tuple] = []  # first a row still without its next, with its chain
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held
        new = [t.encode() for _, t, c in held if c is None]
        made = iter(chains(new, rank))
        held = [(i, t, next(made) if c is None else c) for i, t, c in held]
        ids, texts, own = zip(*held)
        out = _answers(list(ids[:-1]), list(texts[:-1]), list(texts[1:]), list(own[:-1]), list(own[1:]), rank)
        held = held[-1:]
        return out

    for batch in batches:
        for i, text in zip(batch.column("doc_id"), batch.column("text")):
            held.append((i.as_py(), text.as_py(), None))
            size += len(held[-1][1])
            if size >= TOGETHER:
                yield flush()
                size = 0
    if held:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The same of rows that come with the text that follows."""
    for batch in batches:
        for i, text, after in zip(*(batch.column(c) for c in ("doc_id", "text", "following"))):
            pair = [text.as_py(), after.as_py()]
            own, following = chains([x.encode() for x in pair], rank)
            yield _answers([i.as_py()], pair[:1], pair[1:], [own], [following], rank)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its edited text; see the columns of ``_OUT``."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(rarity(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.substring("text", 1, PREFIX).alias("prefix"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, F.desc("key"), "prefix")  # made once, for the walk and for the ends
    walked = ranges.sortWithinPartitions(F.desc("key"), "text").select("doc_id", "text").mapInArrow(lambda it: _walk(it, rank.value), _OUT)
    place = F.struct(F.bitwise_not("key").alias("key"), F.col("text"), F.col("doc_id"))
    ends = ranges.select(F.spark_partition_id().alias("part"), place.alias("x")).groupBy("part").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    order = Window.orderBy("part")  # a row per range
    after = F.coalesce(F.lead("first.text").over(order), F.first("first.text").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select("last.doc_id", "last.text", after.alias("following"))
    return walked.unionByName(ends.mapInArrow(lambda it: _meet(it, rank.value), _OUT))


def op8_digest(docs: DataFrame) -> DataFrame:
    return edited(docs)
