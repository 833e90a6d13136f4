"""The whole of op4's sort, without Spark, against brute force on texts of few letters and short strings."""

import collections
import unittest.mock

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryflow.llm import repeats


def removed(texts, length, gram, targets, hot):
    with unittest.mock.patch.multiple(repeats, LENGTH=length, GRAM=gram, CHOICE=length - gram + 1, RUN=400, PART=40):
        texts = list(dict.fromkeys(texts))  # the operator keeps equal texts once
        column = pa.array(texts, pa.binary())
        ids = pa.array(range(len(texts)), pa.int64())
        rows = [r for b in repeats._anchor_rows(iter([pa.RecordBatch.from_arrays([ids, column], ["id", "text"])])) for r in b.to_pylist()]
        times = collections.Counter(r["h"] for r in rows)
        places = {x: [[r["at"] for r in rows if r["id"] == i and times[r["h"]] > 1 and (times[r["h"]] > hot) == x] for i in range(len(texts))] for x in (False, True)}
        subs = pa.array([0] * len(texts), pa.int32())
        batch = lambda x: pa.RecordBatch.from_arrays([ids, subs, column, pa.array(places[x], pa.list_(pa.int64()))], ["id", "sub", "text", "places"])
        half = len(texts) // 2
        sent = [r for part in (batch(False).slice(0, half), batch(False).slice(half)) for b in repeats._send(iter([part]), targets) for r in b.to_pylist()]
        runs = sorted((r for r in sent if r["target"] is not None), key=lambda r: r["target"])
        merged = repeats._merge(iter([pa.RecordBatch.from_arrays([pa.array([r[c] for r in runs], t) for c, t in (("target", pa.int32()), ("run", pa.binary()))], ["target", "run"])]))
        ranges = [r for b in merged for r in b.to_pylist()] + [r for r in sent if r["target"] is None]
        strings = [r for b in repeats._strings(iter([batch(True)])) for r in b.to_pylist()]
        again = collections.Counter(r["digest"] for r in strings)
        ranges += [{**r, "stop": r["begin"] + length} for r in strings if again[r["digest"]] > 1]
    out = {t: np.zeros(len(t), bool) for t in texts}
    for r in ranges:
        assert r["stop"] - r["begin"] >= length
        out[texts[r["id"]]][r["begin"] : r["stop"]] = True
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=60).map(str.encode), max_size=6), st.integers(6, 14), st.integers(2, 5), st.integers(1, 3), st.sampled_from([0, 2, 1000]))
def test_same_as_brute_force(texts, length, gram, targets, hot):
    seen = collections.Counter(t[k : k + length] for t in set(texts) for k in range(len(t) - length + 1))
    for t, gone in removed(texts, length, gram, targets, hot).items():
        want = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                want[k : k + length] = True
        assert (gone == want).all(), (t, gone, want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), max_size=7))
def test_loser_tree_sorts(lists):
    runs = [sorted((s, b"", w, 0, k, 0, 0, False) for k, s in enumerate(x)) for w, x in enumerate(lists)]
    out = [(n, r[0]) for n, r in repeats.LoserTree([repeats.decode(repeats.front_code(r)) for r in runs])]
    assert [s for _, s in out] == sorted(s for x in lists for s in x)
    assert all(n == repeats.shared(a, b) for (_, a), (n, b) in zip(out, out[1:]))
