"""Removal of repeated byte strings by a distributed suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts somewhere else. Sorting every suffix of
a corpus would move hundreds of bytes per byte, so the sort is narrowed twice without losing a string:

1. Texts. Equal texts are kept once; one that occurs twice is removed whole and only serves the others.
2. Anchors. Every string of ``LENGTH`` bytes owns the leftmost least hash among its ``GRAM``-byte substrings,
   so equal strings have equal anchors at equal places. Only anchors whose hash occurs twice go on.

Around each such anchor a record holds the bytes of the strings that own it. Each task sorts its records by the
suffix that begins at the anchor and sends them on as front-coded runs: the length of the prefix shared with
the record before, then the rest. The receiver merges runs in a loser tree whose nodes keep the prefix that
loser and winner share: a longer shared prefix decides without a look at the bytes, and equal ones are compared
from there on only. Neighbours in the merged order that share ``GRAM`` bytes are one cluster, and in a cluster
shared suffix and shared left context tell which owned strings repeat. Bytes decide, hashes only propose.

A cluster holds what its anchor's texts differ in, so an anchor of over ``HOT`` places is not clustered: its
strings are counted one by one under their 256-bit digests, which decide as they do for whole texts, in a reduced count
and a join that adaptive execution splits. They are as many at any size, only dealt evenly.

Runs are merged target by target, and there are as many targets as keep one at about ``TARGET`` places.

Records of a task that are equal to the last byte are settled there, all their strings repeat, and one of
them is sent on, so a passage of many copies costs one record per task, not one per copy.

Texts are shuffled once, into a table bucketed by the texts' hash; both joins back to them move only positions.

Defined cases: a null or empty text, or one of under ``LENGTH`` bytes, loses nothing; repeated rows are copies
of each other; a null doc_id is kept; other columns are ignored; an empty table gives no rows; a text of one
byte repeated overlaps itself and is removed whole if it is longer than ``LENGTH``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, materialize, raw_text, scratch, steps

LENGTH, GRAM = 200, 64
#: Substrings of GRAM bytes in a string of LENGTH, of which one is its anchor.
CHOICE = LENGTH - GRAM + 1
_PLACE = 24
#: Places of an anchor that are clustered, and places whose records are merged at once, in the mean.
HOT, TARGET = 100_000, 50_000
#: Bytes of a long text that are hashed at once, and of records that a task sorts into one run.
PART, RUN = 1 << 22, 16 << 20


def _least(key: np.ndarray, size: int) -> np.ndarray:
    """Least of key[i : i + size] for every i that has so many."""
    have, step = key, 1
    while step * 2 <= size:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    n = len(key) - size + 1
    return np.minimum(have[:n], have[size - step : size - step + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, place, most, least): each anchor's row, and how far before it the first and last string it owns begin."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = Spans(data).windows(GRAM)
    low = np.uint64((1 << _PLACE) - 1)
    at = (_least(h & ~low | np.arange(len(h), dtype=np.uint64), CHOICE) & low).astype(np.int64)
    start = np.arange(len(at))
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + LENGTH <= offsets[row + 1]
    at, start, row = at[inside], start[inside], row[inside]
    new = np.flatnonzero(np.diff(at, prepend=-1) != 0)
    last = np.append(new[1:], len(at))[: len(new)] - 1
    return row[new], h[at[new]], at[new] - offsets[row[new]], at[new] - start[new], at[new] - start[last]


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, where in it the bytes begin, bytes, offsets): whole rows together, long rows in overlapping parts."""
    for a, b, data, offsets in steps(column):
        if b - a > 1 or len(data) <= PART:
            yield a, 0, data, offsets
            continue
        for k in range(0, len(data) - LENGTH + 1, PART):
            part = data[k : k + PART + LENGTH - 1]
            yield a, k, part, np.array([0, len(part)])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for a, k, data, offsets in _parts(batch.column("text")):
            row, h, place, most, least = anchors(data, offsets)
            packed = (place + k) << 16 | most << 8 | least
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[a + row]), pa.array(packed)], ["h", "id", "at"])


def _once(batches: Iterator[pa.RecordBatch], number: bool) -> Iterator[pa.RecordBatch]:
    """First rows of each key. With ``number``, rows come sorted by (id, key), and keys that share an id are counted."""
    seen: set[bytes] = set()
    last_id, last_key, n = None, None, 0
    for batch in batches:
        keep, sub = [], []
        for k, (i, key) in enumerate(zip(batch.column("id").to_pylist(), batch.column("key").to_pylist())):
            if not number:
                short = key[:16]
                if short not in seen:
                    seen.add(short)
                    keep.append(k)
            elif (i, key) != (last_id, last_key):
                n = n + 1 if i == last_id else 0
                last_id, last_key = i, key
                keep.append(k)
                sub.append(n)
        out = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sub, pa.int32())], [*out.schema.names, "sub"]) if number else out


# --- runs -----------------------------------------------------------------------------------------------------


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return m - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length() // 8 - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() % 8 > 0)


#: A record: suffix from the anchor, context before it, id, sub, place, most, least, whether its strings are known to repeat.
Record = tuple[bytes, bytes, int, int, int, int, int, bool]
_HEAD = struct.Struct("<HHHqiqBB?")


def front_code(records: list[Record]) -> bytes:
    """A sorted run as bytes: each suffix without the prefix that it shares with the one before."""
    out, before = [], b""
    for suffix, left, *rest in records:
        n = shared(before, suffix)
        out += (_HEAD.pack(n, len(suffix) - n, len(left), *rest), suffix[n:], left)
        before = suffix
    return b"".join(out)


def decode(run: bytes) -> Iterator[tuple[int, Record]]:
    """(prefix shared with the record before, record) of a run."""
    at, before = 0, b""
    while at < len(run):
        n, rest, left, *more = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        suffix = before[:n] + run[at : at + rest]
        at += rest
        yield n, (suffix, run[at : at + left], *more)
        at += left
        before = suffix


class LoserTree:
    """Merges sorted runs of (shared prefix with the record before, record) into one of the same kind.

    A node holds the losing run; ``known[run]`` is the prefix that its head shares with the winner that beat it
    last, which by then is the last record put out or one equal to it that far.
    """

    def __init__(self, runs: list[Iterator[tuple[int, Record]]]):
        self.runs = runs
        self.size = max(1, len(runs))
        self.head: list[Record | None] = []
        for r in runs:
            first = next(r, None)
            self.head.append(first and first[1])
        self.known = [0] * self.size
        self.node = [-1] * self.size
        self.winner = -1
        for k in range(len(runs)):
            self._enter(k)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; the loser learns what it shares with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        m, n = self.known[a], self.known[b]
        if m != n:
            return m > n  # both share these with the last record out, so the longer prefix is the lesser string
        k = shared(x[0], y[0], m)
        if k == len(x[0]) or k == len(y[0]):
            first = (len(x[0]), a) < (len(y[0]), b)
        else:
            first = x[0][k] < y[0][k]
        self.known[b if first else a] = k
        return first

    def _enter(self, run: int) -> None:
        """First round: a run climbs until it finds a free node or the top."""
        at = (run + self.size) // 2
        while at >= 1:
            if self.node[at] < 0:
                self.node[at] = run
                return
            if self._beats(self.node[at], run):
                self.node[at], run = run, self.node[at]
            at //= 2
        self.winner = run

    def __iter__(self) -> Iterator[tuple[int, Record]]:
        if not self.runs:
            return
        if self.size == 1:
            self.winner = 0
        while (record := self.head[w := self.winner]) is not None:
            yield self.known[w], record
            after = next(self.runs[w], None)
            self.head[w], self.known[w] = (after[1], after[0]) if after else (None, 0)
            at, run = (w + self.size) // 2, w
            while at >= 1:
                if self._beats(self.node[at], run):
                    self.node[at], run = run, self.node[at]
                at //= 2
            self.winner = run


# --- clusters -------------------------------------------------------------------------------------------------


def _left_shared(records: list[Record], members: list[int]) -> dict[int, int]:
    """For each member, the longest context before the anchor that it shares with another member."""
    order = sorted((records[k][1][::-1], k) for k in members)
    best = dict.fromkeys(members, 0)
    for (x, a), (y, b) in zip(order, order[1:]):
        n = shared(x, y)
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def cluster_repeats(records: list[Record], common: list[int]) -> list[list[tuple[int, int]]]:
    """Which owned strings of each record repeat, as ranges (nearest, farthest) of their begin before the anchor.

    A string that begins o bytes before the anchor needs o bytes of common context and LENGTH - o of common
    suffix with one other record. ``common[k]`` is the suffix that records k - 1 and k share.
    """
    out: list[list[tuple[int, int]]] = [[(r[6], r[5])] if r[7] else [] for r in records]
    for level in sorted({min(c, LENGTH) for c in common[1:] if c >= GRAM}, reverse=True):
        group = [0]
        for k in range(1, len(records) + 1):
            if k < len(records) and common[k] >= level:
                group.append(k)
                continue
            if len(group) > 1:
                for m, n in _left_shared(records, group).items():
                    near, far = max(records[m][6], LENGTH - level), min(records[m][5], n)
                    if near <= far:
                        out[m].append((near, far))
            group = [k]
    return out


_RANGE = "id long, sub int, begin long, stop long"


def _ranges(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = zip(*found) if found else ([], [], [], [])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _RANGE.split(", ")])


def _send(batches: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """Front-coded runs for each target, and the ranges that this task settles itself (target null)."""
    names = ["target", "run", *(x.split()[0] for x in _RANGE.split(", "))]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    records: list[tuple[int, Record]] = []
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        records.sort(key=lambda x: (x[0], x[1][0], x[1][1]))
        sent: dict[int, list[Record]] = {}
        settled, k = [], 0
        while k < len(records):
            target, r = records[k]
            j = k + 1
            while j < len(records) and records[j][0] == target and records[j][1][:2] == r[:2]:
                j += 1
            if j - k > 1:  # equal suffix and context: what both of two own, repeats
                same = [x[1] for x in records[k:j]]
                settled += [(x[2], x[3], x[4] - x[5], x[4] - x[6] + LENGTH) for x in same]
                r = (*r[:5], max(x[5] for x in same), min(x[6] for x in same), True)
            sent.setdefault(target, []).append(r)
            k = j
        out = [(t, front_code(x), None, None, None, None) for t, x in sent.items()] + [(None, None, *x) for x in settled]
        records.clear()
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 10_000]), kinds)], names)

    for batch in batches:
        data, offsets = raw_text(batch.column("text"))
        raw = data.tobytes()
        for row, (i, sub, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "sub", "places")))):
            text = raw[offsets[row] : offsets[row + 1]]
            for packed in places:
                place, most, least = packed >> 16, packed >> 8 & 255, packed & 255
                suffix, left = text[place : place + LENGTH - least], text[place - most : place] if most <= place else b""
                if len(suffix) < LENGTH - least or most > place:
                    continue  # an id that two texts share: the place is the other's
                records.append((int.from_bytes(hashlib.blake2b(suffix[:GRAM], digest_size=8).digest()) % targets, (suffix, left, i, sub, place, most, least, False)))
                held += len(suffix) + most + 300
            if held > RUN:
                yield from rows()
                held = 0
    yield from rows()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and the place of each string that hot anchors own."""
    for batch in batches:
        data, offsets = raw_text(batch.column("text"))
        for row, (i, sub, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "sub", "places")))):
            text = data[offsets[row] : offsets[row + 1]].tobytes()
            packed = np.array(places, np.int64)
            first, last = (packed >> 16) - (packed >> 8 & 255), (packed >> 16) - (packed & 255)
            ok = (first >= 0) & (last + LENGTH <= len(text))
            first, last = first[ok], last[ok]
            n = last - first + 1
            begin = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n))
            for k in range(0, len(begin), 100_000):
                own = begin[k : k + 100_000]
                digests = pa.array([hashlib.sha256(text[b : b + LENGTH]).digest() for b in own.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(np.full(len(own), i)), pa.array(np.full(len(own), sub, np.int32)), pa.array(own)], ["digest", "id", "sub", "begin"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of each target, which come sorted by target, and gives the ranges that repeat."""
    runs: list[bytes] = []
    now = None

    def merged() -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, int]] = []
        cluster: list[Record] = []
        common: list[int] = []

        def settle():
            if len(cluster) > 1:
                for r, spans in zip(cluster, cluster_repeats(cluster, common)):
                    if not r[7]:
                        found.extend((r[2], r[3], r[4] - far, r[4] - near + LENGTH) for near, far in spans)

        for n, r in LoserTree([decode(x) for x in runs]):
            if n < GRAM:
                settle()
                cluster, common = [], []
                if len(found) >= 10_000:
                    yield _ranges(found)
                    found = []
            cluster.append(r)
            common.append(n)
        settle()
        yield _ranges(found)

    for batch in batches:
        for target, run in zip(batch.column("target").to_pylist(), batch.column("run").to_pylist()):
            if target != now and runs:
                yield from merged()
                runs = []
            now = target
            runs.append(run)
    if runs:
        yield from merged()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, given its ranges."""
    for batch in batches:
        data, offsets = raw_text(batch.column("text"))
        rows = []
        for row, (sub, found) in enumerate(zip(batch.column("sub").to_pylist(), batch.column("ranges").to_pylist())):
            text, kept, spans, removed, stop = data[offsets[row] : offsets[row + 1]].tobytes(), [], 0, 0, 0
            for a, b in sorted((r["begin"], r["stop"]) for r in found if r["sub"] == sub):
                if a > stop or not spans:
                    kept.append(text[stop:a])
                    spans += 1
                    removed += b - a
                    stop = b
                elif b > stop:
                    removed += b - stop
                    stop = b
            kept.append(text[stop:])
            rows.append((removed, spans, b"".join(kept)))
        columns = zip(*rows) if rows else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["id", "key", "n_removed", "n_spans", "kept"])


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``: what is left of the texts that lose bytes but
    not all, as bytes (null for the others: their whole text, or nothing)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("id"), F.unhex(F.sha2("text", 256)).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), "text")

    long = rows.where(F.col("n_bytes") >= LENGTH).select("id", "key", F.col("text").cast("binary").alias("text"))
    once = long.mapInArrow(lambda it: _once(it, False), "id long, key binary, text binary")
    once = once.repartition(buckets, "id").sortWithinPartitions("id", "key").mapInArrow(lambda it: _once(it, True), "id long, key binary, text binary, sub int")
    name = f"quarryflow_{uuid.uuid4().hex}"
    once.write.format("parquet").option("compression", "zstd").option("path", scratch(spark, "texts")).bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # resolved now, so the catalog can forget it; the files are external and stay as scratch
    spark.sql(f"drop table {name}")

    found = texts.select("id", "text").mapInArrow(_anchor_rows, "h long, id long, at long")
    # counts are written before they are joined: adaptive execution splits a hot key only between two plain exchanges
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "twice")
    places = materialize(found.join(twice, "h").groupBy("id", "hot").agg(F.collect_list("at").alias("places")), "places")
    usual, hot = (places.where(f"{'' if x else 'not '}hot").select("id", "places") for x in (False, True))
    targets = max(buckets, (usual.agg(F.sum(F.size("places"))).first()[0] or 0) // TARGET)
    sent = texts.select("id", "sub", "text").join(usual, "id").mapInArrow(lambda it: _send(it, targets), "target int, run binary, " + _RANGE)
    sent = materialize(sent, "runs")
    merged = sent.where("target is not null").select("target", "run").repartition(buckets, "target").sortWithinPartitions("target").mapInArrow(_merge, _RANGE)
    ranges = merged.unionByName(sent.where("target is null").select("id", "sub", "begin", "stop"))
    if not hot.isEmpty():
        strings = texts.select("id", "sub", "text").join(hot, "id").mapInArrow(_strings, "digest binary, id long, sub int, begin long")
        again = materialize(strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
        ranges = ranges.unionByName(strings.join(again, "digest", "left_semi").select("id", "sub", "begin", (F.col("begin") + LENGTH).alias("stop")))
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("sub", "begin", "stop")).alias("ranges"))
    left = texts.select("id", "key", "sub", "text").join(ranges, "id").mapInArrow(_cut, "id long, key binary, n_removed long, n_spans long, kept binary")

    own = rows.select("doc_id", "id", "key", "n_bytes")
    copied = own.where(F.col("n_bytes") >= LENGTH).groupBy("id", "key").agg(F.count("*").alias("copies")).where("copies > 1")
    copied = materialize(copied.select("id", "key"), "copied")
    # one table of what became of texts, so that its join with the rows has plain exchanges and copies of one text can be split
    lost = left.where("n_removed > 0").join(copied, ["id", "key"], "left_anti").withColumn("gone", F.lit(False))
    lost = lost.unionByName(copied.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    out = own.join(materialize(lost, "lost"), ["id", "key"], "left")
    gone, cut = F.coalesce("gone", F.lit(False)), F.col("n_removed") > 0
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(cut, F.sha2("kept", 256)).otherwise(F.lower(F.hex("key"))).alias("kept_sha256"),
        F.when(~gone & cut, F.col("kept")).alias("kept"),
    )


def op4_repeats(docs: DataFrame) -> DataFrame:
    return remove(docs).drop("kept")


ORACLE = """with t as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h, row_number() over () as r from documents),
b as (select r, n, k, substr(h, 400 * k + 1, 800) as piece from (select r, h, len(h) // 2 as n, unnest(range(0, len(h) // 400 + 1)) as k from t)),
s as (select r, n, 200 * k + o as i, substr(piece, 2 * o + 1, 400) as x from (select *, unnest(range(0, 200)) as o from b)),
w as (select r, i, md5(x) as x from s where i + 200 <= n),
m as (select r, i from w where x in (select x from w group by x having count(*) > 1)),
e as (select r, i, case when i <= lag(i) over (partition by r order by i) + 200 then 0 else 1 end as new_ from m),
g as (select r, i, sum(new_) over (partition by r order by i) as k from e),
p as (select r, min(i) as a, max(i) + 200 as b from g group by r, k),
q as (select r, a, b, lag(b, 1, 0) over (partition by r order by a) as before from p),
c as (select q.r, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept, max(b) as last
  from q join t on q.r = t.r group by q.r)
select t.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(case when c.r is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from t left join c on t.r = c.r"""
