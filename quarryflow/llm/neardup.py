"""Near-duplicate removal at a given similarity of word shingles: SimHash classes first, then what lies beyond their radius.

Fingerprints are of a text's distinct shingles. The SimHash operator links those within its radius: its blocks of equal
bits, its pivot tables, its components. A class of linked fingerprints is a block here, and as fingerprints alone may
link what is not alike, the exact similarity of shingle sets decides inside it.

At a similarity of 0.8 a pair's 64-bit fingerprints differ in about 10 bits and often in 16, too many for blocks
of equal bits. So further blocks come from min-hash bands of the same shingles (``BANDS`` of ``DEEP`` values: a pair at
0.8 meets with probability 1 - 3e-5, at 0.9 with 1 - 1e-9), and pivot distances say who are neighbours in a block. What is
discarded unseen are pairs whose numbers of distinct shingles rule the similarity out.

First a block proposes a number of pairs linear in its size: each text with the block's first and with its neighbour by
pivot distance. They are verified by the exact similarity of their shingle sets and joined into components, which
settles most blocks. Then every pair of a block that is not in one component is verified: what is outside the block's
largest component meets the whole block, in tiles of at most twice ``TILE`` texts whose common shingles are counted as
products of matrices. Links of both rounds make the components, and of each one row stays: that with the smallest
doc_id. Equal texts are one node from the start, known by one of their rows; ids only choose who stays. Texts are
shuffled once, into a table bucketed by a number of each row; the joins back to it move numbers and hashes only.

Defined cases: a null text is empty, and texts without words are alike; a text of fewer words than a shingle has one
shingle, the whole; a null doc_id counts as the smallest; of rows with equal ids in one component, repeated rows
among them, one stays; different texts that share an id are different nodes. Texts of over ``STEP_BYTES`` are read in
parts, and a word of over half of that may count as several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Spans, bucketed, lean, materialize, mix, pieces, raw_text, runs, steps
from .graph import components
from .simhash import PIVOTS, RADIUS, _Forest, link_edges

WORDS, SIMILARITY = 5, 0.8
BANDS, DEEP = 20, 4
#: Texts, and distinct shingles, of each side of a tile.
TILE, HELD = 512, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_WORD = np.ones(256, bool)
_WORD[0x20] = _WORD[0x09:0x0E] = False


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, repeats included, and the first of each row."""
    begins, ends, first = runs(_WORD[data], offsets)
    h = Spans(_LOWER[data]).of(begins, ends)
    n = np.diff(first)
    width = np.minimum(words, np.maximum(n, 1))
    count = np.where(n > 0, n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        live = width[row] > k
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + h[at[live] + k])
    return out, np.concatenate(([0], np.cumsum(count))).astype(np.int64)


def _hashes(column: pa.Array, words: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of shingles, and the first of each row; of a long row, read in parts, each hash once."""
    for a, b, data, offsets in steps(column):
        if b - a > 1 or len(data) <= limit:
            yield shingles(data, offsets, words)
        else:
            parts = (shingles(part, np.array([0, len(part)]), words)[0] for part, _ in pieces(data, _WORD, words - 1, limit))
            h = np.unique(np.concatenate([np.unique(x) for x in parts]))
            yield h, np.array([0, len(h)])


_SIGNED = "row long, id long, key binary, fp long, size long, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch], words: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    salts = mix(np.arange(1, BANDS * DEEP + 1, dtype=np.uint64))
    for batch in batches:
        fps, sizes, bands = [], [], []
        for h, first in _hashes(batch.column("text"), words, limit):
            least = np.zeros((len(first) - 1, len(salts)), np.uint64)
            full = np.diff(first) > 0
            if full.any():
                for k, salt in enumerate(salts):
                    least[full, k] = np.minimum.reduceat(mix(h ^ salt), first[:-1][full])
            band = np.zeros((len(first) - 1, BANDS), np.uint64)
            for b in range(BANDS):
                band[:, b] = b
                for k in range(DEEP):
                    band[:, b] = mix(band[:, b] * np.uint64(31) + least[:, b * DEEP + k])
            bands += band.view(np.int64).tolist()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                own, ones = np.unique(h[a:b]), np.zeros(64, np.int64)
                for k in range(0, len(own), 1 << 14):
                    ones += np.unpackbits(own[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
                fps.append(int(np.packbits(ones * 2 > len(own)).view(np.int64)[0]))
                sizes.append(len(own))
        columns = [*(batch.column(c) for c in ("row", "id", "key")), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SIGNED.split(", ")])


def block_pairs(ids: np.ndarray, fp: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block that are worth verifying."""
    near = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((ids, near[:, 1], near[:, 0]))
    lead = int(np.argmin(ids))
    a = np.concatenate((order[:-1], np.full(len(ids), lead)))
    b = np.concatenate((order[1:], np.arange(len(ids))))
    keep = (a != b) & (np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
    return a[keep], b[keep]


def _pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of each block; rows come sorted by band, and a block may span batches."""
    held = [np.empty(0, np.int64)] * 4

    def proposed(band, ids, fp, shingled):
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        first = np.flatnonzero(np.diff(band, prepend=band[0] - 1 if len(band) else 0) != 0) if len(band) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(band)))
        for k in np.flatnonzero(size > 1):
            own = slice(first[k], first[k] + size[k])
            a, b = block_pairs(ids[own], fp[own].view(np.uint64), shingled[own], similarity)
            u.append(ids[own][a])
            v.append(ids[own][b])
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            rows = [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(held, ("band", "id", "fp", "size"))]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[last:] for x in rows]
            if last:
                yield proposed(*(x[:last] for x in rows))
    yield proposed(*held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks of more than one text; rows come sorted by band."""
    tail, sent = None, None  # a last row that is alone so far, or else the band of the last row
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        band = rows.column("band").to_numpy()
        same = np.concatenate(([band[0] == sent], band[1:] == band[:-1], [False]))
        keep = same[:-1] | same[1:]
        tail, sent = (None, band[-1]) if keep[-1] else (rows.slice(len(band) - 1), None)
        yield rows.filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch], words: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for h, first in _hashes(batch.column("text"), words, limit):
            out += [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "set"])


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (x, i), (y, j), keep = raw_text(batch.column("a")), raw_text(batch.column("b")), []
        for k in range(batch.num_rows):
            a, b = x[i[k] : i[k + 1]].tobytes(), y[j[k] : j[k + 1]].tobytes()
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= similarity * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def close(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of sets that are so similar."""
    size, m = np.array([len(x) for x in sets], np.int64), len(sets)
    row = np.repeat(np.arange(m), size)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    row, first = row[order], np.cumsum(n) - n
    both = np.zeros((m, m), np.float64 if size.max(initial=0) >= 1 << 24 else np.float32)
    heavy = np.flatnonzero((n > 1) & (n * 16 > m))
    for k in range(0, len(heavy), 4096):  # shingles of many sets: a product of matrices
        own = heavy[k : k + 4096]
        has = np.zeros((m, len(own)), both.dtype)
        at = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + np.repeat(first[own], n[own])
        has[row[at], np.repeat(np.arange(len(own)), n[own])] = 1
        both += has @ has.T
    light = np.flatnonzero((n > 1) & (n * 16 <= m))
    for k in range(2, int(n[light].max(initial=0)) + 1):  # of few: pair by pair
        own = light[n[light] == k]
        step = max(1, (1 << 20) // (k * k))
        for s in range(0, len(own), step):
            members = row[first[own[s : s + step], None] + np.arange(k)]
            a, b = np.repeat(members, k, 1).ravel(), np.tile(members, k).ravel()
            both += np.bincount(a * m + b, minlength=m * m).reshape(m, m).astype(both.dtype)
    a, b = np.nonzero(both >= similarity * (size[:, None] + size[None, :] - both.astype(np.float64)))
    return a[a < b], b[a < b]


def _tiles(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between the components that meet in each tile, at least a spanning forest; rows come sorted by tile."""
    held: list[tuple] = []

    def links(rows):
        ids, roots, sets = zip(*[r[1:] for r in rows])
        place = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        at, forest = np.array([place[r] for r in roots]), _Forest(len(place))
        a, b = close(sets, similarity)
        a, b = a[at[a] != at[b]], b[at[a] != at[b]]
        out = [(ids[x], ids[y]) for x, y, u, v in zip(a.tolist(), b.tolist(), at[a].tolist(), at[b].tolist()) if forest.join(u, v)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        data, offsets = raw_text(batch.column("set"))
        for k, (tile, i, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "id", "root")))):
            if held and held[0][0] != tile:
                yield links(held)
                held = []
            held.append((tile, i, root, np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), np.uint64)))
    if held:
        yield links(held)


def unsettled(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile, id, root): every pair of a block's texts (band, id, size) that have different roots is in one tile at least."""
    roots = roots.select(F.col("node").alias("id"), "root")
    blocks = materialize(blocks.join(roots, "id", "left").select("band", "id", "size", F.coalesce("root", "id").alias("root")), "blocks")
    side = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("held") / HELD)).alias("side")
    parts = blocks.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("held"))
    most = parts.groupBy("band").agg(F.max(F.struct("n", "root", "held")).alias("most"), F.sum("n").alias("n"), F.sum("held").alias("held"), F.count("*").alias("roots")).where("roots > 1 and n > 2")  # the pair of a block of two was proposed
    # chunks of what is outside the largest component, then chunks of that; a block that is one tile is one chunk
    whole = most.select("band", side, F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("n"), (F.col("held") - F.col("most.held")).alias("held"), F.col("most.n").alias("n_most"), F.col("most.held").alias("held_most"))
    one = F.col("side") <= 1
    rest = whole.select(
        "band", "most", F.when(one, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / TILE), F.ceil(F.col("held") / HELD))).alias("few"),
        F.when(one, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_most") / TILE), F.ceil(F.col("held_most") / HELD))).alias("many"),
    )
    rows = blocks.join(rest, "band")
    inside, spread = (F.col("root") == F.col("most")) & (F.col("many") > 0), F.xxhash64("id")
    chunk = F.when(inside, F.col("few") + F.pmod(spread, F.greatest("many", F.lit(1)))).otherwise(F.pmod(spread, F.col("few")))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    rows = rows.select("band", "id", (F.col("few") + F.col("many")).alias("chunks"), chunk.alias("chunk"), meets.alias("other")).where("chunks = 1 or chunk <> other")
    tiles = rows.groupBy("band", F.least("chunk", "other"), F.greatest("chunk", "other")).agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
    tiles = materialize(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    return tiles.select("tile", F.explode("ids").alias("id")).join(roots, "id", "left").select("tile", "id", F.coalesce("root", "id").alias("root"))


def classes(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The SimHash classes of ``nodes`` (id, fp, size) as blocks: (band, id, fp, size)."""
    linked = components(link_edges(nodes.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    return nodes.join(linked, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp")).alias("band"), "id", "fp", "size")


_ROW = "neardup_row"


def groups(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, stays) of each distinct text of ``rows`` (row, id, text): one of its rows, and the row that stays of its
    component."""
    key = F.unhex(F.sha2("text", 256)).alias("key")
    signed = materialize(rows.select("row", "id", key, "text").mapInArrow(lambda it: lean(_signatures(it, words)), _SIGNED), "signatures")
    nodes = signed.groupBy("key").agg(F.min(F.struct("id", "row")).alias("best"), F.min_by(F.struct("fp", "size", "bands"), "row").alias("own"))
    nodes = materialize(nodes.select(F.col("best.row").alias("id"), F.col("best.id").alias("doc_id"), "own.fp", "own.size", "own.bands"), "nodes")
    blocks = classes(nodes).unionByName(nodes.select(F.explode("bands").alias("band"), "id", "fp", "size"))
    blocks = blocks.repartition("band").sortWithinPartitions("band").mapInArrow(_shared, blocks.schema)
    blocks = materialize(blocks, "shared")
    pairs = blocks.repartition("band").sortWithinPartitions("band").mapInArrow(lambda it: _pairs(it, similarity), "u long, v long")
    pairs = materialize(pairs.distinct(), "pairs")
    asked = blocks.select(F.col("id").alias("row")).distinct()
    sets = rows.join(asked, "row", "left_semi").select(F.col("row").alias("id"), "text")
    sets = materialize(sets.mapInArrow(lambda it: lean(_sets(it, words)), "id long, set binary"), "sets")
    left, right = (sets.select(F.col("id").alias(x), F.col("set").alias(y)) for x, y in ("ua", "vb"))
    # sides of plain exchanges, so that adaptive execution splits a text that is in very many pairs
    met = pairs.join(left, "u").join(right, "v")
    met = materialize(met.select("u", "v", "a", "b").mapInArrow(lambda it: lean(_alike(it, similarity)), "u long, v long"), "met")
    left_over = unsettled(blocks, components(met))
    left_over = left_over.join(sets, "id").repartition("tile").sortWithinPartitions("tile").select("tile", "id", "root", "set")
    more = left_over.mapInArrow(lambda it: lean(_tiles(it, similarity)), "u long, v long")
    roots = components(met.unionByName(more))
    own = nodes.select("id", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "id")).alias("first")).select("root", F.col("first.id").alias("stays"))
    return own.join(first, "root").select(F.col("id").alias("node"), "stays")


def keep_first(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they came."""
    numbered = bucketed(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows", _ROW)
    texts = numbered.select(
        F.col(_ROW).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    stay = groups(texts, words, similarity).where("node = stays").select(F.col("node").alias(_ROW))
    return numbered.join(stay, _ROW, "left_semi").select(*docs.columns)
