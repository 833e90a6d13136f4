"""Benchmark decontamination with a stored positional inverted index of the training texts.

``index`` cuts the texts into chunks and writes one row for each term of a chunk: its positions there, as differences.
Rows are dealt and sorted by term, those of terms that are frequent in a chunk by term and chunk, so that no term's
postings are one task's; what a lookup of few terms reads is few row groups.

``hits`` joins the benchmark's phrases to the index. Terms are counted over the whole corpus, each phrase meets the
postings of its rarest term only, and only for the chunks that these name are the lists of its other terms fetched and
dealt by chunk. There each occurrence of the rarest term looks up the nearest place of the term before it, then of the
one before that, and so to both ends: offset-adjusted lists intersected from the rarest. At a slop of 0 the places must
be neighbours, which is an exact phrase; above it so many other words may lie between, which is a proximity match.

Nothing of the corpus or the benchmark goes through the driver, and no task holds more than a chunk and its lists:
phrases stream past them. A text of over ``CHUNK`` bytes is several chunks, each after the ``CONTEXT`` words before it.

Defined cases: a null or empty text has no words; a null ``item_id`` is written as an empty string; items with the same
id count once; items without words have no phrase; repeated document rows are answered one by one; words of over
``LONG`` bytes are known by their SHA-256; columns besides those named are ignored. Empty tables give empty or clean
results. A chunk's words are told apart by 64-bit hashes and lengths, terms of the index by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Spans, lean, materialize, raw_text, runs

WINDOW = 10
#: Bytes of text in a chunk, words of a long text that a chunk repeats from the one before, bytes of a word kept as it is.
CHUNK, CONTEXT, LONG = 6 << 20, 64, 256
#: Occurrences in a chunk from which a term's rows are dealt by chunk too.
HEAVY = 1 << 12
#: Candidate places that are tested at once.
TESTED = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_DOC = "struct<key:long,doc_id:long,h:long,lo:long,begin:long,stop:long,place:long,more:boolean>"
_INDEX = f"term string, chunk long, n long, at binary, docs array<{_DOC}>"


# --- the index ------------------------------------------------------------------------------------------------


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of sorted spans of a buffer and of their lengths, a part of it at a time."""
    out = (ends - begins).astype(np.uint64)
    for at in range(0, len(data), STEP_BYTES):
        a, b = np.searchsorted(begins, (at, at + STEP_BYTES))
        if a < b:
            out[a:b] ^= Spans(data[at : ends[b - 1]]).of(begins[a:b] - at, ends[a:b] - at)
    return out


def _terms(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct words of a chunk, and the number of each occurrence's."""
    size, number = ends - begins, np.empty(len(begins), np.int64)
    long = size > LONG
    at, inside = begins, low
    if long.any():  # the hashes need only the bytes of the others
        stays = np.ones(len(low), bool)
        for b, e in zip(begins[long].tolist(), ends[long].tolist()):
            stays[b:e] = False
        at, inside = begins - np.concatenate(([0], np.cumsum(np.where(long, size, 0))))[:-1], low[stays]
    h = _word_hashes(inside, at[~long], at[~long] + size[~long])
    _, first, number[~long] = np.unique(h, return_index=True, return_inverse=True)
    raw, at, size = inside.tobytes(), at[~long][first].tolist(), size[~long][first].tolist()
    names = [raw[a : a + n].decode("utf-8", "replace") for a, n in zip(at, size)]
    known: dict[str, int] = {}
    for k in np.flatnonzero(long).tolist():
        name = "sha256:" + hashlib.sha256(low[begins[k] : ends[k]].tobytes()).hexdigest()
        number[k] = known.setdefault(name, len(names) + len(known))
    return names + list(known), number


def _cut(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long row in parts of at least ``limit`` bytes that end where no word does not."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + limit)
        while stop < len(data) and _WORD[data[stop - 1]]:  # on to the end of the word
            inside = np.flatnonzero(~_WORD[data[stop : stop + limit]])
            stop = min(len(data), stop + limit) if not len(inside) else stop + int(inside[0]) + 1
        yield data[at:stop]
        at = stop


def _chunk(number: int, docs: pa.StructArray, low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    names, term = _terms(low, begins, ends)
    order = np.argsort(term, kind="stable")
    n = np.bincount(term, minlength=len(names))
    first = np.cumsum(n) - n
    steps = np.diff(order, prepend=0)
    steps[first] = order[first]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), docs.type)
    columns = [x.split()[0] for x in _INDEX.split(", ")[:5]]
    listed = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.array([number], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, kinds[3]), listed], columns)
    offsets = np.append(first, len(order)).astype(np.int64) * 4
    blobs = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(steps.astype("<u4").tobytes())]).cast(pa.binary())
    for k in range(0, len(names), 20_000):
        part = slice(k, k + 20_000)
        m = len(names[part])
        yield pa.RecordBatch.from_arrays([pa.array(names[part], kinds[0]), pa.array(np.full(m, number)), pa.array(n[part]), blobs.slice(k, 20_000), pa.nulls(m, listed.type)], columns)


def _index(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 40
    number = key = base

    def described(ids: pa.Array, h: pa.Array, keys, lo, begin, stop, place, more) -> pa.StructArray:
        own = [pa.array(np.asarray(x, np.int64)) for x in (keys, lo, begin, stop, place)]
        return pa.StructArray.from_arrays([own[0], ids, h, *own[1:], pa.array(more, pa.bool_())], ["key", "doc_id", "h", "lo", "begin", "stop", "place", "more"])

    for batch in batches:
        ids, h = batch.column("doc_id"), batch.column("h")
        data, offsets = raw_text(batch.column("text"))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
            own = data[offsets[a] : offsets[b]]
            if b - a > 1 or len(own) <= limit:
                low = _LOWER[own]
                begins, ends, first = runs(_WORD[own], offsets[a : b + 1] - offsets[a])
                docs = described(ids.slice(a, b - a), h.slice(a, b - a), key + np.arange(b - a), first[:-1], first[:-1], first[1:], np.zeros(b - a), np.zeros(b - a, bool))
                yield from _chunk(number, docs, low, begins, ends)
                number += 1
            else:
                before, place, done = [np.empty(0, np.uint8)] * 0, 0, 0
                for part in _cut(own, limit):
                    done += len(part)
                    low = _LOWER[np.concatenate([*before, part])]
                    begins, ends, first = runs(_WORD[low], np.array([0, len(low)]))
                    known = len(before) // 2
                    docs = described(ids.slice(a, 1), h.slice(a, 1), [key], [0], [known], [len(begins)], [place], [done < len(own)])
                    yield from _chunk(number, docs, low, begins, ends)
                    number += 1
                    place += len(begins) - known
                    before = [x for s, e in zip(begins[-CONTEXT:].tolist(), ends[-CONTEXT:].tolist()) for x in (low[s:e].copy(), np.array([0x20], np.uint8))]
            key += b - a
            a = b


def index(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The stored index: a row per term and chunk, and one per chunk (term null) that says which words are whose."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = rows.mapInArrow(lambda it: lean(_index(it, chunk)), _INDEX)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = F.when(F.col("term").isNull() | (F.col("n") >= HEAVY), F.col("chunk")).otherwise(0)
    return materialize(rows.repartition(parts, "term", alone).sortWithinPartitions("term"), "index", "zstd")


# --- phrases --------------------------------------------------------------------------------------------------


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, terms): the distinct windows of each item."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(
        F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)),
        lambda w: F.when(F.octet_length(w) > LONG, F.concat(F.lit("sha256:"), F.sha2(w, 256))).otherwise(w),
    )
    each = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1))))
    return each.select("item", "words", starts.alias("k")).select("item", F.slice("words", F.col("k"), F.least(F.size("words"), F.lit(window))).alias("terms")).distinct()


class Shard:
    """The lists of one chunk: a sorted array of term * span + position."""

    def __init__(self, tids: np.ndarray, lists: list[np.ndarray], words: int):
        order = np.argsort(tids)
        self.tids, self.span = tids[order], words + 2
        lists = [lists[k] for k in order]
        n = np.array([len(x) for x in lists], np.int64)
        self.keys = np.concatenate([np.empty(0, np.int64), *lists]) + np.repeat(np.arange(len(n)) * self.span, n)
        self.first = np.concatenate(([0], np.cumsum(n)))

    def local(self, tids: np.ndarray) -> np.ndarray:
        """The chunk's numbers of terms, -1 for those that it has not."""
        if not len(self.tids):
            return np.full(len(tids), -1)
        at = np.minimum(np.searchsorted(self.tids, tids), len(self.tids) - 1)
        return np.where(self.tids[at] == tids, at, -1)

    def find(self, terms: np.ndarray, length: np.ndarray, place: np.ndarray, starts: np.ndarray, stops: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(phrase, first word, one past the last) of every match around an occurrence of the term at ``place`` of a phrase,
        in blocks; ``starts`` and ``stops`` are those of the rows."""
        rare = terms[np.arange(len(terms)), place]
        n = self.first[rare + 1] - self.first[rare]
        size = np.cumsum(n)
        for block in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(size // TESTED)) + 1):
            w = np.repeat(block, n[block])
            k = np.arange(len(w)) - np.repeat(np.cumsum(n[block]) - n[block], n[block]) + np.repeat(self.first[rare[block]], n[block])
            at = self.keys[k] - rare[w] * self.span
            row = np.searchsorted(starts, at, "right") - 1
            ok = at < stops[row]
            w, at, row = w[ok], at[ok], row[ok]
            ends = []
            for way in (-1, 1):
                here = at.copy()
                for d in range(1, terms.shape[1]):
                    j = place[w] + way * d
                    live = (j >= 0) & (j < length[w])
                    t = terms[w, np.where(live, j, 0)]
                    if way < 0:
                        k = np.searchsorted(self.keys, t * self.span + here) - 1
                        have = k >= self.first[t]
                    else:
                        k = np.searchsorted(self.keys, t * self.span + here, "right")
                        have = k < self.first[t + 1]
                    to = self.keys[np.clip(k, 0, len(self.keys) - 1)] - t * self.span
                    ok = ~live | have & (np.abs(to - at) <= d + slop) & (to >= starts[row]) & (to < stops[row])
                    here = np.where(live, to, here)[ok]
                    w, at, row = w[ok], at[ok], row[ok]
                    ends = [x[ok] for x in ends]
                ends.append(here)
            ok = ends[1] - ends[0] + 1 - length[w] <= slop
            yield w[ok], ends[0][ok], ends[1][ok] + 1


_HITS = "key long, phrase long, n_hit long, position long"
_MET = f"chunk long, kind int, tid long, at binary, docs array<{_DOC}>, phrase long, place int, tids array<long>"


def _hit_rows(key=(), phrase=None, n_hit=None, position=None) -> pa.RecordBatch:
    columns = [pa.nulls(len(key), pa.int64()) if x is None else pa.array(np.asarray(x, np.int64)) for x in (key, phrase, n_hit, position)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _HITS.split(", ")])


def _intersect(batches: Iterator[pa.RecordBatch], slop: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (chunk, kind): what words are whose, then lists, then phrases."""
    now, docs, tids, lists, shard, edge = None, None, [], [], None, None

    def over() -> Iterator[pa.RecordBatch]:
        """What the words of a chunk that is over are."""
        if edge is None or not edge.any():
            return
        hit = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
        counted = np.where(docs["more"], np.maximum(docs["begin"], docs["stop"] - CONTEXT), docs["stop"])
        n = hit[counted] - hit[docs["begin"]]
        yield _hit_rows(docs["key"][n > 0], n_hit=n[n > 0])
        for k in np.flatnonzero((docs["lo"] < docs["begin"]) | docs["more"]).tolist():  # words that two chunks hold
            at = np.concatenate((np.arange(docs["lo"][k], docs["begin"][k]), np.arange(counted[k], docs["stop"][k])))
            at = at[hit[at + 1] > hit[at]]
            yield _hit_rows(np.full(len(at), docs["key"][k]), position=at - docs["begin"][k] + docs["place"][k])

    for batch in batches:
        chunk, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
        cut = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(chunk)]):
            if a == b:
                continue
            if chunk[a] != now:
                yield from over()
                now, tids, lists, shard, edge = chunk[a], [], [], None, None
            own = batch.slice(a, b - a)
            if kind[a] == 0:
                found = own.column("docs").flatten()
                docs = {f: found.field(f).to_numpy(zero_copy_only=False) for f in ("key", "lo", "begin", "stop", "place", "more")}
            elif kind[a] == 1:
                tids.append(own.column("tid").to_numpy())
                data, offsets = raw_text(own.column("at"))
                lists += [np.cumsum(np.frombuffer(data[s:e].tobytes(), "<u4").astype(np.int64)) for s, e in zip(offsets[:-1], offsets[1:])]
            else:
                if shard is None:
                    words = int(docs["stop"][-1])
                    shard, edge = Shard(np.concatenate([np.empty(0, np.int64), *tids]), lists, words), np.zeros(words + 1, np.int64)
                listed = own.column("tids")
                length = np.diff(listed.offsets.to_numpy())
                terms = np.full((len(length), int(length.max())), -1, np.int64)
                inside = np.arange(terms.shape[1]) < length[:, None]
                terms[inside] = shard.local(listed.flatten().to_numpy())
                ok = ((terms >= 0) | ~inside).all(1)
                names, place = own.column("phrase").to_numpy()[ok], own.column("place").to_numpy()[ok]
                if not ok.any():
                    continue
                for w, s, e in shard.find(terms[ok], length[ok], place, docs["lo"], docs["stop"], slop):
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    if len(w):
                        row = np.searchsorted(docs["lo"], s, "right") - 1
                        pairs = np.unique(np.stack([docs["key"][row], names[w]], 1), axis=0)
                        yield _hit_rows(pairs[:, 0], phrase=pairs[:, 1])
    yield from over()


def hits(stored: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Matches of ``phrases`` (phrase, terms) in an index: rows (key, phrase) of what a text holds, and rows (key, n_hit) or
    (key, position) that count and name its words inside matches."""
    lists = stored.where("term is not null")
    each = phrases.select("phrase", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "term"))
    found = lists.join(each.select("term").distinct(), "term", "left_semi")
    counts = materialize(found.groupBy("term").agg(F.sum("n").alias("total")).withColumn("tid", F.monotonically_increasing_id()), "terms")
    plans = each.join(counts, "term").groupBy("phrase", "length").agg(
        F.min(F.struct("total", "place", "tid")).alias("rare"), F.array_sort(F.collect_list(F.struct("place", "tid"))).alias("terms")
    ).where(F.size("terms") == F.col("length"))
    plans = materialize(plans.select("phrase", F.col("rare.tid").alias("tid"), F.col("rare.place").alias("place"), F.transform("terms", lambda x: x["tid"]).alias("tids")), "plans")
    found = lists.join(counts.select("term", "tid"), "term").select("tid", "chunk", "at")
    named = materialize(lists.select("term", "chunk").join(counts.select("term", "tid"), "term").select("tid", "chunk").join(plans, "tid").select("chunk", "phrase", "place", "tids"), "candidates")
    needed = named.select("chunk", F.explode("tids").alias("tid")).distinct()
    empty = {x.split()[0]: F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _MET.split(", ")}
    rows = lambda df, kind, *have: df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in have else e for c, e in empty.items()))
    met = rows(stored.where("term is null").join(named.select("chunk").distinct(), "chunk", "left_semi"), 0, "chunk", "docs")
    met = met.unionByName(rows(found.join(needed, ["chunk", "tid"], "left_semi"), 1, "chunk", "tid", "at")).unionByName(rows(named, 2, "chunk", "phrase", "place", "tids"))
    met = met.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return materialize(met.mapInArrow(lambda it: lean(_intersect(it, slop)), _HITS), "hits")


def _asked(docs: DataFrame, items: DataFrame, window: int, slop: int, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the matches, and (phrase, item)."""
    if not 0 <= slop <= CONTEXT - window:
        raise ValueError(f"a window and its slop take at most {CONTEXT} words")
    asked = materialize(windows(items, window), "windows")
    phrases = materialize(asked.select("terms").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    stored = index(docs, chunk)
    return stored, hits(stored, phrases, slop), asked.join(phrases, "terms").select("phrase", "item")


def _held(stored: DataFrame) -> DataFrame:
    return stored.where("term is null").select(F.explode("docs").alias("d")).select("d.*")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (the ids of items with a matching phrase, sorted as strings).

    ``slop`` 0 asks for exact phrases; more allows that many other words between a phrase's words.
    """
    stored, met, members = _asked(docs, items, window, slop, chunk)
    words = _held(stored).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("stop") - F.col("begin")).alias("n_words"))
    shared = met.where("position is not null").select("key", "position").distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    n_hit = met.where("n_hit is not null").select("key", "n_hit").unionByName(shared).groupBy("key").agg(F.sum("n_hit").alias("n_hit"))
    own = met.where("phrase is not null").select("key", "phrase").distinct().join(members, "phrase").select("key", "item").distinct()
    own = own.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = words.join(n_hit, "key", "left").join(own, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark phrase, with the columns as they came."""
    stored, met, _ = _asked(docs, items, window, 0, chunk)
    gone = _held(stored).select("key", "doc_id", "h").join(met.where("phrase is not null").select("key").distinct(), "key", "left_semi")
    none = F.lit(-(1 << 63))  # a hash and an id together, so that texts of one hash are not taken for each other
    gone = gone.select(F.coalesce("doc_id", none).alias("decontam_id"), F.col("h").alias("decontam_h")).distinct()
    keys = F.coalesce(F.col("doc_id").cast("long"), none).alias("decontam_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("decontam_h")
    return docs.select("*", *keys).join(gone, ["decontam_id", "decontam_h"], "left_anti").select(*docs.columns)


def op10_decontam(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = find(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def near_phrases(docs: DataFrame, items: DataFrame, slop: int = 3) -> DataFrame:
    """Documents and benchmark items that share ten words in order, with at most ``slop`` others between."""
    found = find(docs, items, slop=slop).where("n_hit > 0")
    return found.select("doc_id", "n_hit", F.explode("items").alias("item_id"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""with it as (select cast(item_id as varchar) as id, {_SQL_WORDS} as w from benchmark),
iw as (select distinct id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as p
  from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from it where len(w) > 0)),
d as (select doc_id, {_SQL_WORDS} as w from documents),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as p
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from iw) where len(w) >= n)),
hit as (select dw.doc_id, dw.i, dw.n, iw.id from dw join iw on dw.p = iw.p and dw.n = iw.n),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by doc_id),
x as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join h on d.doc_id = h.doc_id left join x on d.doc_id = x.doc_id"""
