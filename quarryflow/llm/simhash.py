"""SimHash near-duplicates, their links found through pivot distance tables.

A fingerprint's row in the table is its Hamming distances to ``PIVOTS`` fixed reference fingerprints. By the
triangle inequality two fingerprints within radius r differ by at most r in every coordinate, so a pair whose
largest coordinate difference is over r is discarded, and the survivors are verified by their exact distance.

Coordinates alone do not say which pairs to look at: at 64 bits a pair of unrelated fingerprints is within 2
of another coordinate a third of the time. So pairs are formed inside blocks. The bits are cut into r + 2
parts, of which r differing bits leave at least two whole; a block holds the distinct fingerprints that agree
on one pair of parts. Inside a block the fingerprints are sorted by their first coordinate, and only those
within r of each other there go on to the other coordinates. A block of over ``LARGE`` fingerprints is cut
again, by the same rule, on the bits that it leaves free; one of over ``HOT`` is cut so before it is dealt, and at
radius 2 what agrees on two levels of parts has 16 free bits, 65,536 fingerprints at most. No pair within the
radius is lost at any size.

Only distinct fingerprints are blocked, so copies cost one row. A block gives a spanning forest of its links,
never its pairs, and components are joined up over the whole table by stars.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; a
null doc_id takes part, and a component of nulls only has a null id; repeated rows are answered one by one;
other columns are ignored. A text of over ``STEP_BYTES`` is read in parts that end with a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, materialize, raw_text
from .graph import components

WORDS, RADIUS, SEED, BITS = 3, 2, 42, 64
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(16)], np.uint64)
#: Fingerprints of a block that are compared without cutting it again, and pairs that are held at once.
LARGE, HELD = 2048, 1 << 19
#: Fingerprints of a block that go to one task.
HOT = 1 << 16


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, words: int = WORDS, limit: int = STEP_BYTES) -> int:
    """Of one text's UTF-8 bytes, read in parts of about ``limit`` bytes; the words before a part that its shingles need stay."""
    digest, ones, n, tokens, at = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + limit)
        stop = cut.end() if cut else len(text)
        tokens += text[at:stop].lower().split()
        at = stop
        if len(tokens) < words:
            continue
        joined, size = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(size + 1) - 1
        begins = (ends - size)[: len(tokens) - words + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[words - 1 :].tolist())], np.uint64)
        for k in range(0, len(hashes), 1 << 15):
            part = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += part.sum(0, dtype=np.int32)
        n += len(hashes)
        tokens = tokens[len(tokens) - words + 1 :]
    if not n:
        return digest(b" ".join(tokens), SEED) if tokens else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = raw_text(batch.column("text"))
        found = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, fp long")


def _masks(bits: list[int], radius: int) -> list[np.uint64]:
    """Masks of each pair of the radius + 2 parts that these bits are cut into."""
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, radius + 2)]
    return [np.uint64(a | b) for a, b in combinations(parts, 2)]


def _levels(radius: int) -> tuple[list[np.uint64], list[list[np.uint64]]]:
    """The blocks' masks, and for each the masks that it is cut by again."""
    first = _masks(list(range(BITS)), radius)
    return first, [[m | x for x in _masks([b for b in range(BITS) if not int(m) >> b & 1], radius)] for m in first]


def _table(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The pivot table, a row for each block that a fingerprint is in."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        near = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
        near = pa.array([x.tobytes() for x in near], pa.binary())
        for k, mask in enumerate(_levels(radius)[0]):
            n = len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array((fp & mask).view(np.int64)), batch.column("fp"), near], ["part", "block", "fp", "near"])


def _cut_again(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of hot blocks, once for each block that they are cut into; parts of the second level are numbered on."""
    first, second = _levels(radius)
    for batch in batches:
        part, fp = batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        for k in range(len(first)):
            masks = np.array([own[k] for own in second])[part]
            number = (len(first) * (part + 1) + k).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array((fp & masks).view(np.int64)), batch.column("fp"), batch.column("near")], ["part", "block", "fp", "near"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _within(fp: np.ndarray, near: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius: sorted by one pivot, discarded by the largest coordinate difference, verified."""
    order = np.argsort(near[:, 0], kind="stable")
    fp, near = fp[order], near[order].astype(np.int16)
    first = np.arange(1, len(fp) + 1)
    past = np.searchsorted(near[:, 0], near[:, 0] + radius, "right")
    size = np.cumsum(past - first)
    for rows in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(size // HELD)) + 1):
        n = past[rows] - first[rows]
        a = np.repeat(rows, n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)
        for k in range(1, near.shape[1]):
            keep = np.abs(near[a, k] - near[b, k]) <= radius
            a, b = a[keep], b[keep]
        keep = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        yield order[a[keep]], order[b[keep]]


def block_links(fp: np.ndarray, near: np.ndarray, fixed: np.uint64, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links inside one block."""
    forest, out = _Forest(len(fp)), []
    groups: Iterator[np.ndarray] = iter([np.arange(len(fp))])
    if len(fp) > LARGE:
        free = [b for b in range(BITS) if not int(fixed) >> b & 1]

        def cut() -> Iterator[np.ndarray]:
            for mask in _masks(free, radius):
                key = fp & mask
                order = np.argsort(key, kind="stable")
                yield from (g for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(g) > 1)

        groups = cut()
    for g in groups:
        for a, b in _within(fp[g], near[g], radius):
            out += [(x, y) for x, y in zip(g[a].tolist(), g[b].tolist()) if forest.join(x, y)]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each block; rows come sorted by (part, block), and a block may span batches."""
    first, second = _levels(radius)
    masks = [*first, *(m for own in second for m in own)]
    waiting: list[tuple] = []

    def links(part, block, fp, near):
        cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(fp)])))
        a = first[size == 2]  # by far the most blocks that have pairs at all
        ok = (np.abs(near[a].astype(np.int16) - near[a + 1]).max(1, initial=0) <= radius) & (np.bitwise_count(fp[a] ^ fp[a + 1]) <= radius)
        u, v = [fp[a[ok]]], [fp[a[ok] + 1]]
        for k in np.flatnonzero(size > 2):
            own = slice(first[k], first[k] + size[k])
            if pairs := block_links(fp[own], near[own], masks[part[first[k]]], radius):
                x, y = np.array(pairs).T
                u.append(fp[own][x])
                v.append(fp[own][y])
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = (batch.column("part").to_numpy(), batch.column("block").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), raw_text(batch.column("near"))[0].reshape(-1, len(PIVOTS)))
        waiting.append(new)
        if (new[0][0], new[1][0]) == (new[0][-1], new[1][-1]) == (waiting[0][0][-1], waiting[0][1][-1]):
            continue  # one block goes on and on: its distinct fingerprints are few bytes each
        part, block, fp, near = (np.concatenate(x) for x in zip(*waiting))
        last = np.flatnonzero((part != part[-1]) | (block != block[-1]))
        last = int(last[-1]) + 1 if len(last) else 0
        waiting = [(part[last:], block[last:], fp[last:], near[last:])]
        if last:
            yield links(part[:last], block[:last], fp[:last], near[:last])
    if waiting:
        yield links(*(np.concatenate(x) for x in zip(*waiting)))


def link_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the distinct fingerprints ``fp``, at least a spanning forest of each block's."""
    if not 0 <= radius <= 6:
        raise ValueError("the blocks hold enough bits for a radius up to 6")
    shape = "part int, block long, fp long, near binary"
    rows = distinct.select("fp").mapInArrow(lambda it: _table(it, radius), shape)
    size = materialize(rows.groupBy("part", "block").agg(F.count("*").alias("n")).where(F.col("n") > HOT).drop("n"), "hot")
    if not size.isEmpty():
        rows = rows.join(size, ["part", "block"], "left_anti").select("part", "block", "fp", "near").unionByName(
            rows.join(size, ["part", "block"], "left_semi").select("part", "block", "fp", "near").mapInArrow(lambda it: _cut_again(it, radius), shape)
        )
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block")
    return rows.mapInArrow(lambda it: _links(it, radius), "u long, v long")


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    own = materialize(fingerprints(docs, words), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    roots = materialize(components(link_edges(distinct, radius)), "components")
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = known.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    ids = known.join(least, "root", "left").where("linked or n > 1").select("fp", F.coalesce("least", "first").alias("component_id"))
    return own.join(ids, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_simhash(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
