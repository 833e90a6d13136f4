"""Near-dedup against what its definition says, on texts that its first proposals do not settle."""

import collections
import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from quarryflow.llm import neardup

from .test_cases import SAID, SCHEMA
from .test_pipeline import shingles
from .test_queries import classes


def kept(spark, rows):
    return sorted((r["doc_id"] for r in neardup.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def words(dice, n):
    return [f"w{dice.randrange(10**9)}" for _ in range(n)]


def test_repeated_lines_do_not_tell_copies_apart(spark):
    dice, rows = random.Random(1), []
    for k in range(20):  # 300 words and a line of 7, a hundred times or twice: the same set of shingles but for one or two
        own, line = words(dice, 300), words(dice, 7)
        rows += [(2 * k, " ".join(own + line * 100)), (2 * k + 1, " ".join(own + line * 3))]
    assert kept(spark, rows) == sorted(range(0, 40, 2), key=str)


def edits(dice, n):
    """A text of 300 words, and n texts that differ from it in 5 words each: 0.85 like it, under 0.8 like each other."""
    own, out = words(dice, 300), []
    for _ in range(n):
        edit = list(own)
        for at in dice.sample(range(5, 295, 10), 5):
            edit[at] = words(dice, 1)[0]
        out.append(" ".join(edit))
    return " ".join(own), out


def test_edits_meet_their_original_whatever_its_id(spark):
    original, texts = edits(random.Random(2), 1000)
    assert kept(spark, [(500, original)] + [(k + (k >= 500), t) for k, t in enumerate(texts)]) == [0]


def test_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    dice = random.Random(3)
    groups = [edits(dice, 60) for _ in range(2)]
    rows = [(k, t) for k, t in enumerate([*groups[0][1], groups[0][0], groups[1][0], *groups[1][1]])]
    assert kept(spark, rows) == [0, 61]


def test_close_is_brute_force():
    dice = random.Random(4)
    sets = []
    for _ in range(60):
        own = dice.sample(range(1, 10**6), 40)
        sets += [{*dice.sample(own, 38), *dice.sample(range(60), k)} for k in (0, 1, 5)]
    sets += [set(), set(), {7}]
    a, b = neardup.close([np.array(sorted(x), np.uint64) for x in sets], 0.8)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 60


def test_rows_that_share_an_id(spark):
    near, _ = edits(random.Random(6), 1)
    copy, other = edits(random.Random(6), 1)[1][0], SAID(200)
    for rows in list(itertools.permutations([(1, near), (5, copy), (5, other)]))[::3]:
        got = neardup.keep_first(spark.createDataFrame(list(rows), SCHEMA)).collect()
        assert sorted(map(tuple, got)) == [(1, near), (5, other)]
    assert len(kept(spark, [(None, near), (None, copy)])) == 1
    assert kept(spark, [(3, other)] * 3 + [(4, near)]) == [3, 4]


def test_a_long_text_in_parts_is_the_whole():
    column = pa.array([SAID(3000), SAID(2), "", SAID(800)])
    rows = [pa.RecordBatch.from_arrays([pa.array([1] * 4), pa.array([1] * 4), pa.array([b""] * 4), column], ["row", "id", "key", "text"])]
    whole, parts = (pa.Table.from_batches(list(neardup._signatures(iter(rows), 5, limit))) for limit in (1 << 20, 300))
    alone = pa.Table.from_batches([x for k in range(4) for x in neardup._signatures(iter([rows[0].slice(k, 1)]), 5, 300)])
    assert whole == parts == alone


def test_all_of_a_table_against_a_set_join(spark):
    """The stage's own threshold over sf0.1: kept rows are those of an exact join over shingle sets."""
    docs = pd.read_parquet("/root/testdata/sf0.1/documents.parquet")[["doc_id", "text"]].sort_values("doc_id")
    sets, first = {}, {}
    for i, text in docs.itertuples(index=False):
        first.setdefault(frozenset(shingles(text)), i)
    sets = sorted(first, key=len)
    count = collections.Counter(x for s in sets for x in s)
    index, links = collections.defaultdict(list), []
    for k, s in enumerate(sets):
        seen, size = set(), len(s)
        rare = sorted(s, key=lambda x: (count[x], x))
        for x in rare[: size - math.ceil(0.8 * size) + 1]:
            seen.update(index[x])
            index[x].append(k)
        for j in seen:
            both = len(s & sets[j])
            if both >= 0.8 * (size + len(sets[j]) - both):
                links.append((j, k))
    root, want = classes(len(sets), links), {}
    for k, s in enumerate(sets):
        want[root[k]] = min(want.get(root[k], first[s]), first[s])
    assert len(links) > 20
    assert kept(spark, list(docs.itertuples(index=False, name=None))) == sorted(want.values(), key=str)
